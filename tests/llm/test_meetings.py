"""What cells hand on when a group of near copies meets documents that are half like it."""

import numpy as np
import pyarrow as pa

from quillspark.llm import jaccard


def _cells_of(texts, parts):
    """Rows of all cells, as the operator deals them, and the documents' sets."""
    g, sizes = jaccard._sets(pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"]), 1, jaccard.SHINGLE)
    keys, n_keys = jaccard._prefix(g, sizes, np.zeros(1 << jaccard.BUCKETS, np.int32))
    ends = np.cumsum(sizes)
    sets = [set(g[e - n : e].tolist()) for e, n in zip(ends, sizes, strict=True)]
    points = [np.bincount((g[e - n : e] % np.uint64(jaccard.GROUPS)).astype(int), minlength=jaccard.GROUPS).tolist() for e, n in zip(ends, sizes, strict=True)]
    doc = np.repeat(np.arange(len(texts)), n_keys)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n_keys) - n_keys, n_keys)
    lists = [keys[doc == i].view(np.int64).tolist() for i in range(len(texts))]
    (sketched,) = jaccard._sketches(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "keys"])]))
    order = np.lexsort((sizes[doc], keys.view(np.int64)))
    doc, place, cell = doc[order], place[order], keys.view(np.int64)[order]
    cols = [cell, doc, sizes[doc], np.array(parts)[doc], np.full(len(doc), -1), place]
    nested = [pa.array([points[i] for i in doc], pa.list_(pa.int32())), sketched.column(1).take(pa.array(doc)), sketched.column(2).take(pa.array(doc)), pa.array(cell & (jaccard.SKETCH - 1))]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), *nested], ["cell", "doc_id", "n", "part", "half", "place", "point", "sketch", "spare", "bit"]), sets


def test_half_like_documents_do_not_meet_a_whole_group_in_every_cell(monkeypatch):
    r = np.random.default_rng(8)
    word = lambda: f"w{r.integers(1 << 40)}"
    base = [word() for _ in range(400)]

    def changed(span):
        at = int(r.integers(400 - span))
        return " ".join([*base[:at], *(word() for _ in range(span)), *base[at + span :]])

    texts = [changed(2) for _ in range(40)] + [changed(100) for _ in range(60)] + [changed(int(n)) for n in r.integers(5, 60, 5)]
    parts = [0] * 40 + list(range(1, 66))
    _, sets = _cells_of(texts, parts)
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    links = {(i, j) for j in range(105) for i in range(j) if parts[i] != parts[j] and share(i, j) >= 0.8}

    def met(rows):
        return [x for b in jaccard._cells(iter([rows])) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]

    rows, _ = _cells_of(texts, parts)
    every, some = met(rows.select(rows.schema.names[:7])), met(rows)
    assert links <= set(some) and len(links) > 100
    assert len(every) > 80_000 and len(some) < len(every) / 2
    # so few bits that keys of a set often fall on one
    monkeypatch.setattr(jaccard, "SKETCH", 64)
    monkeypatch.setattr(jaccard, "_BELOW", np.packbits(np.tri(64, k=-1, dtype=bool), axis=1, bitorder="little").view("<u8"))
    assert links <= set(met(_cells_of(texts, parts)[0]))
