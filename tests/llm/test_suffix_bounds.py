import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from kinmatch.llm import suffix_dedup


def rows(shards, each, windows=1):
    """(record batches as match gets them, key and content of the records whose windows come twice in their shard)."""
    rng = np.random.default_rng(3)
    out, twice = {c: [] for c in ("key", "slice", "content", "skip", "n", "bytes")}, set()
    for k in range(shards):
        own = [bytes(rng.integers(97, 123, 199 + windows, dtype=np.uint8)) for _ in range(each)]
        if k % 3 == 0:
            own[-1] = own[0]
        for c, raw in enumerate(own):
            for name, x in zip(out, (k // 2, k % 2, c, 0, windows, raw), strict=True):
                out[name].append(x)
        twice |= {(k // 2, k % 2, c) for c in range(each) if own.count(own[c]) > 1}
    schema = pa.schema([("key", pa.int64()), ("slice", pa.int32()), ("content", pa.int64()), ("skip", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())])
    return pa.Table.from_pydict(out, schema).to_batches(max_chunksize=130), twice


def test_a_family_is_bounded_in_bytes(monkeypatch):
    """A record of one window has 200 bytes of its own, so a bound on windows alone lets a task hold 200 times as many bytes."""
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 5_000, raising=False)
    held, add = [], suffix_dedup.Family.add

    def seen(self, *a, **k):
        add(self, *a, **k)
        held.append((len(self.text.data), len(a[0])))

    monkeypatch.setattr(suffix_dedup.Family, "add", seen)
    batches, twice = rows(shards=400, each=5)
    found = pa.Table.from_batches(list(suffix_dedup.match(iter(batches)))).to_pylist()
    assert sorted((r["key"], r["content"]) for r in found) == sorted((k, c) for k, _, c in twice)
    assert max(x for x, _ in held) < 50_000 and max(y for _, y in held) <= 5_000


def test_windows_of_different_shards_are_never_compared(monkeypatch):
    """Texts that begin alike in many shards: only pairs of one shard are looked at."""
    compared, common = Counter(), suffix_dedup.Text.common

    def counted(self, x, y):
        compared["pairs"] += len(x)
        return common(self, x, y)

    monkeypatch.setattr(suffix_dedup.Text, "common", counted)
    schema = rows(1, 1)[0][0].schema
    tail = lambda i: hashlib.sha256(str(i).encode()).hexdigest().encode()[:50]
    made = [{"key": k, "slice": 0, "content": c, "skip": 0, "n": 1, "bytes": b"x" * 150 + tail((k, c))} for k in range(500) for c in range(2)]
    found = list(suffix_dedup.match(iter([pa.RecordBatch.from_pylist(made, schema)])))
    assert sum(b.num_rows for b in found) == 0 and compared["pairs"] <= 2_000


def test_fetched_rows_come_in_portions():
    """One text with many narrow slices is handed on in portions, and no window is lost."""
    raw = bytes(np.random.default_rng(1).integers(97, 123, 384, dtype=np.uint8)).decode()
    wanted = [{"key": 1, "content": c, "at": 0, "n": 185, "lead": 184, "parts": 400_000} for c in range(150)]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("content", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("lead", pa.int32()), ("parts", pa.int32())]))
    batch = pa.record_batch({"text": pa.array([raw]), "wanted": pa.array([wanted], kind)})
    out = list(suffix_dedup.fetch(iter([batch])))
    assert sum(sum(b.column("n").to_pylist()) for b in out) == 150 * 185 and max(b.nbytes for b in out) < 6_000_000
