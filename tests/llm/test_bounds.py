"""What a task of an operator holds and sends at once."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from stepwise.llm import line_dedup, phrases


def _batch(texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts, pa.binary())], ["lang", "text"])


def test_survivors_leave_in_short_batches():
    n = 2 * phrases.SENT + 5
    all_pass = SimpleNamespace(value=np.full((phrases.ROWS, 1 << 10), 0xFF, np.uint8))
    batches = list(phrases._survivors(all_pass, 1)(iter([_batch([" ".join(f"w{i}" for i in range(n)).encode()])])))
    assert max(b.num_rows for b in batches) <= phrases.SENT
    assert [p for b in batches for p in b.column("phrase").to_pylist()] == [f"w{i}" for i in range(n)]


def test_bytes_that_are_no_text_are_replaced_in_phrases():
    words = [pa.array([b"a", b"\xc3"], pa.binary()), pa.array(["é".encode(), b"b"], pa.binary())]
    assert phrases._written(words).to_pylist() == ["a é", "� b"]


def test_lines_are_normal_whatever_white_space_they_hold():
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace() and chr(c) != "\n"]
    texts = [f"{a}Ab{b}c​{a}{b}d{b}\n {a}\n\nplain words\n é{a}" for a in blanks for b in (" ", "\t", "　")]
    for text in texts:
        assert line_dedup.normal_lines(text) == [" ".join(x.split()) for x in text.lower().split("\n")]


def test_keys_of_several_lines_are_sent_as_ranges(monkeypatch):
    """A hot key leaves a task as two lines a sort at most, and rows are ranges of keys, not keys."""
    monkeypatch.setattr(line_dedup, "SORTED_KEYS", 5000)
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 63), 1 << 63, (2000, line_dedup.BANDS), dtype=np.int64)
    keys[::2, 3], keys[7, 5], keys[1999, 0], keys[4, 1], keys[5, 1] = 17, keys[8, 2], keys[0, 11], -(1 << 63), (1 << 63) - 1
    lines = rng.integers(-(1 << 63), 1 << 63, 2000, dtype=np.int64)
    keys, lines = np.concatenate((keys, keys[:50])), np.concatenate((lines, lines[:50]))
    batch = pa.RecordBatch.from_arrays([pa.array(lines), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["line", "bands"])
    sent = list(line_dedup._key_parts(16)(batch.slice(i, 100) for i in range(0, 2050, 100)))
    assert sum(b.num_rows for b in sent) <= 16 * len(sent) and len(sent) == 5
    assert sum(np.count_nonzero(np.frombuffer(x, np.int64) == 17) for b in sent for x in b.column("keys").to_pylist()) <= 2 * len(sent)
    table = pa.Table.from_batches(sent).sort_by("part")
    found = [k for b in line_dedup._shared_keys(iter(table.to_batches(7))) for k in b.column("key").to_pylist()]
    of: dict[int, set[int]] = {}
    for line, row in zip(lines.tolist(), keys.tolist(), strict=True):
        for k in row:
            of.setdefault(k, set()).add(line)
    assert sorted(found) == sorted(k for k, x in of.items() if len(x) > 1) and 17 in found
