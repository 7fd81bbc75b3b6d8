"""python -m kinmatch train|link|evaluate|validate|subset|density: linkage of TSV files from the command line."""

from kinmatch.cli import main

raise SystemExit(main())
