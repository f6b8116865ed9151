"""Removal of byte strings that repeat across documents, by blockwise suffix sorting.

A byte goes if a string of LENGTH bytes over it also starts in a document of a smaller
id. Suffixes are sorted one bucket at a time. The cover sample that buckets and ranks
rest on is content-defined: of the GRAM-byte grams in each window of LENGTH bytes the
one of least hash, the first of equal ones, is the window's sample position. Equal
windows so have their sample at the same offset and fall into the same bucket. (A fixed
difference cover would sample about 2.5 times as many positions.) In a bucket, the text
to the right and to the left of each sample position is sorted once; ranks of these
settle ties for all windows at once: two windows are equal if their samples agree in rank
on both sides as far as the window reaches. No hash decides what is removed.

    1. Texts equal as a whole are collapsed to the smallest id.
    2. By chunk of documents, distinct sample hashes go to buckets, which tell each chunk
       the ones that other chunks have, too.
    3. By chunk, sample positions of such hashes, or of hashes in two documents of the
       chunk, go to buckets with the text around them; what agrees within a chunk goes
       once, as the rest is covered by the smallest of them.
    4. By bucket, covered windows are found; by chunk, they are joined to spans.

A chunk holds about CHUNK_BYTES of text, whatever the input's size; a hash, however
common, occurs in a bucket a few times a chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # how far a window may begin before its sample position
CHUNK_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20

_RIGHT = "chunk int, kind int, doc_id long, sha binary, x binary, y binary, z binary"
_COPY, _HASHES, _SPANS = 0, 1, 2
_RECORDS = "bucket int, chunk int, kind int, h binary, doc binary, pos binary, count binary, back binary, around binary"


def samples(data: np.ndarray, ends: np.ndarray):
    """Records of a block of texts, one after another in data, that end at ends.

    (text, first window, windows, sample position, hash): each for a run of windows that
    share a sample position.
    """
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    grams = n - GRAM + 1
    word = lambda at, kind: np.ndarray((grams,), kind, data, at, (1,))  # noqa: E731  unaligned views
    h = word(0, "<u8") * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += word(8, "<u8") * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += word(16, "<u4") * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low, at = h, np.arange(grams, dtype=np.int32)
    for step in (1, 2, 4, 8, REACH - 15):  # a window has REACH + 1 = 31 grams
        left, right = low[: len(low) - step], low[step:]
        later = right < left
        at = np.where(later, at[step:], at[: len(at) - step])
        low = np.minimum(left, right)
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    window = np.arange(n - LENGTH + 1)
    window = window[window + LENGTH <= ends[owner[: len(window)]]]
    if not len(window):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    sample = at[window].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], sample[1:] != sample[:-1])))
    first, sample = window[new], sample[new]
    return owner[first], first, np.diff(np.append(new, len(window))), sample, h[sample]


def _blocks(texts: list[bytes]):
    """(data, ends, place in texts, offset in text) of blocks; a long text comes in overlapping parts."""
    parts, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), BLOCK_BYTES):
            part = t[at : at + BLOCK_BYTES + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            parts.append((i, at, part))
            size += len(part)
            if size >= BLOCK_BYTES:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts):
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    return data, np.cumsum([len(p[2]) for p in parts]), np.array([p[0] for p in parts]), np.array([p[1] for p in parts])


def _own(left, right) -> tuple[list[int], list[bytes]]:
    """Ids and texts of the documents of a chunk that stand for their text, each once."""
    right = right.select(["kind", "doc_id", "sha"]).filter(_equal(right["kind"], _COPY))
    stand = set(zip(right["doc_id"].to_pylist(), right["sha"].to_pylist()))
    ids, texts, seen = [], [], set()
    for i, sha, text in zip(left["doc_id"].to_pylist(), left["sha"].to_pylist(), left["text"]):
        if (i, sha) in stand and (i, sha) not in seen:
            seen.add((i, sha))
            ids.append(i)
            texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
    return ids, texts


def _equal(column, value):
    import pyarrow.compute as pc

    return pc.equal(column, value)


def _row_table(rows: list[dict], schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.Table.from_pylist(rows, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]))


def _join(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), kind)


def _local(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of an array that occur in two documents or more, sorted."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    return np.unique(h[1:][(h[1:] == h[:-1]) & (doc[1:] != doc[:-1])])


def _send_hashes(buckets: int):
    def run(left, right):
        if not left.num_rows or not right.num_rows:  # a side without rows comes without columns
            return _row_table([], "bucket int, chunk int, h binary")
        _, texts = _own(left, right)
        h = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(samples(d, e)[4]) for d, e, _, _ in _blocks(texts))]))
        chunk = left["chunk"][0].as_py()
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        h = h[order]
        rows = [{"bucket": b, "chunk": chunk, "h": h[s:e].tobytes()} for b, (s, e) in enumerate(zip(edges, edges[1:])) if e > s]
        return _row_table(rows, "bucket int, chunk int, h binary")

    return run


def _answer_hashes(table):
    """For each chunk, its hashes that other chunks of the bucket's table have, too."""
    chunks, parts = table["chunk"].to_pylist(), [np.frombuffer(x, "<u8") for x in table["h"].to_pylist()]
    h = np.sort(np.concatenate(parts))
    shared = np.unique(h[1:][h[1:] == h[:-1]])
    rows = []
    for c, part in zip(chunks, parts):
        mine = part[np.isin(part, shared, assume_unique=True)]
        if len(mine):
            rows.append({"chunk": c, "kind": _HASHES, "doc_id": None, "sha": None, "x": mine.tobytes(), "y": None, "z": None})
    return _row_table(rows, _RIGHT)


def _send_records(buckets: int):
    def run(left, right):
        if not left.num_rows or not right.num_rows:  # a side without rows comes without columns
            return _row_table([], _RECORDS)
        ids, texts = _own(left, right)
        chunk = left["chunk"][0].as_py()
        shared = np.sort(_join(right.filter(_equal(right["kind"], _HASHES))["x"], "<u8"))
        ids_of = np.array(ids, np.int64)
        # hashes of two documents of this chunk: found in a first pass, as blocks are smaller than a chunk
        seen = [(h, ids_of[place[o]]) for d, e, place, _ in _blocks(texts) for o, _, _, _, h in [samples(d, e)]]
        if not seen:
            return _row_table([], _RECORDS)
        shared = np.union1d(shared, _local(np.concatenate([x[0] for x in seen]), np.concatenate([x[1] for x in seen])))
        del seen
        found = []
        for data, ends, place, offset in _blocks(texts):
            owner, first, count, sample, h = samples(data, ends)
            use = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h if len(shared) else np.zeros(len(h), bool)
            owner, first, count, sample, h = (x[use] for x in (owner, first, count, sample, h))
            if not len(h):
                continue
            begin = np.concatenate(([0], ends[:-1]))[owner]
            padded = np.concatenate((np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)))
            around = np.lib.stride_tricks.sliding_window_view(padded, REACH + LENGTH)[sample]
            # what lies outside the windows of a record plays no part
            column = np.arange(REACH + LENGTH)
            around = around * ((column >= (REACH - (sample - first))[:, None]) & (column < (REACH - (sample - first) + count - 1 + LENGTH)[:, None]))
            found.append((h, ids_of[place[owner]], (first - begin + offset[owner]).astype(np.int32), count.astype(np.uint8), (sample - first).astype(np.uint8), around.astype(np.uint8)))
        if not found:
            return _row_table([], _RECORDS)
        h, doc, pos, count, back, around = (np.concatenate(x) for x in zip(*found))
        # records that agree in all but the document: all after the smallest document's are covered by it
        mark = np.concatenate((h[:, None].view(np.uint8).reshape(-1, 8), count[:, None], back[:, None], around), axis=1)
        mark = np.ascontiguousarray(mark).view(f"V{mark.shape[1]}").ravel()
        _, group = np.unique(mark, return_inverse=True)
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, doc)
        covered = doc > least[group]
        send = np.flatnonzero(~covered)
        rows = []
        bucket = (h[send] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        send, edges = send[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b, (s, e) in enumerate(zip(edges, edges[1:])):
            if e > s:
                i = send[s:e]
                rows.append({"bucket": b, "chunk": chunk, "kind": 1, "h": h[i].tobytes(), "doc": doc[i].tobytes(), "pos": pos[i].tobytes(), "count": count[i].tobytes(), "back": back[i].tobytes(), "around": around[i].tobytes()})
        if covered.any():
            s, e = pos[covered], pos[covered] + count[covered] - 1 + LENGTH
            rows.append({"bucket": chunk % buckets, "chunk": chunk, "kind": 0, "h": None, "doc": doc[covered].tobytes(), "pos": s.astype(np.int32).tobytes(), "count": e.astype(np.int32).tobytes(), "back": None, "around": None})
        return _row_table(rows, _RECORDS)

    return run


def _ranked(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, agree): records sorted by hash and text, and how many bytes each agrees in with the one before; -1 where the hash differs."""
    width = -(-text.shape[1] // 8) * 8
    padded = np.zeros((len(text), width), np.uint8)
    padded[:, : text.shape[1]] = text
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], h))
    t, hs = text[order], h[order]
    differ = t[1:] != t[:-1]
    agree = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
    return order, np.concatenate(([-1], np.where(hs[1:] == hs[:-1], agree, -1)))


def covered_windows(h, doc, count, back, around) -> np.ndarray:
    """For each record, whether its window that begins b bytes before the sample also begins in a smaller document: (records, REACH + 1)."""
    out = np.zeros((len(h), REACH + 1), bool)
    right_order, right_agree = _ranked(h, around[:, REACH:])
    left_order, left_agree = _ranked(h, around[:, REACH - 1 :: -1] if REACH else around[:, :0])
    rank_right, rank_left = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    back, count = back.astype(np.int64), count.astype(np.int64)
    for b in range(REACH + 1):
        has = np.flatnonzero((back >= b) & (back - count < b))
        if len(has) < 2:
            continue
        rank_right[right_order] = np.cumsum(right_agree < LENGTH - b)
        rank_left[left_order] = np.cumsum(left_agree < b)
        key = rank_right[has] << 32 | rank_left[has]
        order = np.argsort(key, kind="stable")
        key, docs = key[order], doc[has][order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        least = np.minimum.reduceat(docs, np.flatnonzero(new))[np.cumsum(new) - 1]
        out[has[order], b] = docs > least
    return out


def _answer_records(table):
    rows = []
    local = table.filter(_equal(table["kind"], 0))
    for r in local.to_pylist():
        rows.append({"chunk": r["chunk"], "kind": _SPANS, "doc_id": None, "sha": None, "x": r["doc"], "y": r["pos"], "z": r["count"]})
    sent = table.filter(_equal(table["kind"], 1))
    if sent.num_rows:
        h, doc, pos = _join(sent["h"], "<u8"), _join(sent["doc"], "<i8"), _join(sent["pos"], "<i4")
        count, back = _join(sent["count"], np.uint8), _join(sent["back"], np.uint8)
        around = _join(sent["around"], np.uint8).reshape(-1, REACH + LENGTH)
        chunk = np.repeat(np.array(sent["chunk"].to_pylist()), [len(x) // 8 for x in sent["h"].to_pylist()])
        # in order of place: the window b bytes before the sample begins back - b after the first
        covered = covered_windows(h, doc, count, back, around)[:, ::-1]
        edge = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        record, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        base = pos[record].astype(np.int64) + back[record] - REACH
        s, e, d, c = (base + first).astype(np.int32), (base + last + LENGTH).astype(np.int32), doc[record], chunk[record]
        order = np.argsort(c, kind="stable")
        s, e, d, c = s[order], e[order], d[order], c[order]
        for a, z in zip(*(lambda k: (k, np.append(k[1:], len(c))))(np.flatnonzero(np.concatenate((np.ones(min(1, len(c)), bool), c[1:] != c[:-1]))))):
            rows.append({"chunk": int(c[a]), "kind": _SPANS, "doc_id": None, "sha": None, "x": d[a:z].tobytes(), "y": s[a:z].tobytes(), "z": e[a:z].tobytes()})
    return _row_table(rows, _RIGHT)


_RESULT = "doc_id long, sha binary, kept binary, n_removed long, n_spans long"


def _remove(keep_text: bool):
    def run(left, right):
        if not left.num_rows or not right.num_rows:  # a side without rows comes without columns
            return _row_table([], _RESULT)
        ids, texts = _own(left, right)
        spans = right.filter(_equal(right["kind"], _SPANS))
        doc, s, e = _join(spans["x"], "<i8"), _join(spans["y"], "<i4").astype(np.int64), _join(spans["z"], "<i4").astype(np.int64)
        order = np.lexsort((s, doc))
        doc, s, e = doc[order], s[order], e[order]
        shas = dict(zip(right["doc_id"].to_pylist(), right["sha"].to_pylist()))
        several = {}
        for i, sha in zip(left["doc_id"].to_pylist(), left["sha"].to_pylist()):
            several.setdefault(i, set()).add(sha)
        rows = []
        for i, text in zip(ids, texts):
            a, z = np.searchsorted(doc, i, "left"), np.searchsorted(doc, i, "right")
            removed = n = 0
            kept, at = [], 0
            if z > a:
                upto = np.maximum.accumulate(e[a:z])
                new = np.concatenate(([True], s[a + 1 : z] > upto[:-1]))
                begins, stops = s[a:z][new], upto[np.append(np.flatnonzero(new)[1:] - 1, z - a - 1)]
                for b, x in zip(begins.tolist(), stops.tolist()):
                    kept.append(text[at:b])
                    at, removed, n = x, removed + x - b, n + 1
            kept.append(text[at:])
            rest = b"".join(kept)
            sha = hashlib.sha256(text).digest() if len(several[i]) > 1 else shas[i]
            rows.append({"doc_id": i, "sha": sha, "kept": rest if keep_text else hashlib.sha256(rest).digest(), "n_removed": removed, "n_spans": n})
        return _row_table(rows, _RESULT)

    return run


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row; kept: the remaining bytes, or their SHA-256 if not keep_text.

    Null text is as empty. Rows with a null id remove nothing and lose nothing. Rows of one
    id don't remove from each other; rows that agree in id and text each get the result.
    Where rows of one id differ in text, all are judged on all spans found for that id's
    texts, so ids should be unique. Other columns aren't read. No rows: none.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk")
    known = rows.filter("doc_id is not null")
    by_chunk = known.select(chunk, "doc_id", "sha", "text").groupBy("chunk")
    # a name and an expression of its own: the two sides of a cogroup must not share a column
    stand = known.groupBy(F.concat("sha", F.lit(b"")).alias("own")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.concat("own", F.lit(b"")).alias("sha"))
    none = F.lit(None).cast("binary")
    right = stand.select(chunk, F.lit(_COPY).alias("kind"), "doc_id", "sha", none.alias("x"), none.alias("y"), none.alias("z"))
    pairs = lambda more: by_chunk.cogroup((right if more is None else right.unionByName(more)).groupBy("chunk"))
    hashes = pairs(None).applyInArrow(_send_hashes(chunks), "bucket int, chunk int, h binary").groupBy("bucket").applyInArrow(_answer_hashes, _RIGHT)
    records = pairs(hashes).applyInArrow(_send_records(chunks), _RECORDS).groupBy("bucket").applyInArrow(_answer_records, _RIGHT)
    result = pairs(records).applyInArrow(_remove(keep_text), _RESULT).select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"), "kept", "n_removed", "n_spans")
    rest = F.lit(b"") if keep_text else F.unhex(F.sha2(F.lit(b""), 256))
    slim = rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes"), *([F.col("text")] if keep_text else []))
    same = slim.join(result, (slim["doc_id"] == result["__id"]) & (slim["sha"] == result["__sha"]), "left")
    copy = F.col("__id").isNull() & F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH)
    whole = F.col("text") if keep_text else F.col("sha")
    return same.select(
        F.col("doc_id").alias("id"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, rest).otherwise(F.coalesce("kept", whole)).alias("kept"),
    )
