"""Token-ID output with Re-Pair grammar compression.

Documents are dealt to parts by ranges of their ids, in ascending order. A part is written
by one task as a run of shards of about SHARD_TOKENS ids, each with a grammar of its own.
In a shard, frequent pairs of neighbouring ids are repeatedly replaced by nonterminals (as
many pairs at a time as don't touch, so that a round is a few array operations) until no
pair occurs LEAST_COUNT times: of two-byte symbols a rule takes eight bytes and an
occurrence saves two. A shard's row holds

    part, shard, local_start    its place; ids of the part before it
    n_tokens, width             ids in the shard; bytes of a stored symbol (2 or 4)
    doc_ids, doc_tokens         the documents and how many ids each has
    symbols                     the compressed ids
    left, right, expansion      for nonterminal first_rule + i: its two symbols, and how
                                many ids it stands for
    first_rule

The ids end a document with end_id, which no rule contains, so documents begin at symbol
boundaries. Expansion lengths let a reader go to any id by a prefix sum and expand only
the symbols it needs. The container is Parquet, so any store that Spark writes to will do
and a lost task is written anew.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch

SHARD_TOKENS = 1 << 20
DOCS_A_PART = 100_000  # beyond spark.sql.shuffle.partitions times as many documents, there are more parts
RULES_A_ROUND = 8192
LEAST_COUNT = 8
REMEMBERED, REMEMBERED_BYTES = 1 << 18, 1 << 25  # parts of texts, and bytes of these and their ids, after which half of what a worker remembers goes

SHARD_SCHEMA = (
    "part int, shard int, local_start long, n_tokens long, width int, first_rule long, "
    "doc_ids array<long>, doc_tokens array<long>, symbols binary, `left` binary, `right` binary, expansion binary"
)


class Encoder:
    """ids of texts by a vocabulary file of the tokenizers library.

    Its pre-tokenization never joins characters across ASCII white space, so texts are
    encoded piece by piece between white space, each distinct piece of a batch once, and
    the ids of pieces are remembered: what was used since the last change of generation,
    and the generation before.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks themselves run side by side
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.letters = None
        if _keeps_letters(path):  # lower-case ASCII letters go to the merges as they are
            self.letters = Tokenizer.from_file(path)
            self.letters.normalizer, self.letters.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.bytes = 0

    def _remember(self, pieces: list[bytes], ids: list[bytes]) -> None:
        self.young.update(zip(pieces, ids))
        self.bytes += sum(map(len, pieces)) + sum(map(len, ids))
        if len(self.young) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.young, self.old, self.bytes = {}, self.young, 0

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece its ids, four bytes each."""
        out = list(map(self.young.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        again, new = [], []
        for i in missing:
            out[i] = self.old.get(pieces[i])
            (new if out[i] is None else again).append(i)
        plain, other = [], []
        for i in new:
            w = pieces[i]
            (plain if self.letters and w.isascii() and w.isalpha() and w.islower() else other).append(i)
        for library, some in ((self.letters, plain), (self.library, other)):
            for at in range(0, len(some), 16384):
                part = some[at : at + 16384]
                found = library.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in part], add_special_tokens=False)
                lists = [e.ids for e in found]
                flat = np.fromiter(itertools.chain.from_iterable(lists), "<u4", sum(map(len, lists))).tobytes()
                end = 0
                for i, ids in zip(part, lists):
                    out[i] = flat[end : end + 4 * len(ids)]
                    end += 4 * len(ids)
        changed = again + new
        self._remember([pieces[i] for i in changed], [out[i] for i in changed])
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each) for an Arrow array of strings; null: none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        pieces = split.flatten().dictionary_encode()
        distinct = pieces.dictionary
        raw = distinct.buffers()[2].to_pybytes() if distinct.buffers()[2] else b""
        at = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1].tolist()
        ids = pa.array(self._ids([raw[a:b] for a, b in zip(at, at[1:])]), pa.large_binary()).take(pieces.indices)
        upto = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] >> 2
        bounds = upto[np.asarray(split.offsets) - split.offsets[0].as_py()]
        all_ids = np.frombuffer(ids.buffers()[2], "<u4") if ids.buffers()[2] else np.zeros(0, "<u4")
        return all_ids[bounds[0] : bounds[-1]], np.diff(bounds)


def _keeps_letters(path: str) -> bool:
    """Whether normalizer and pre-tokenizer of a vocabulary file pass a piece of lower-case ASCII letters on as one piece, unchanged."""
    import json

    data = json.load(open(path, encoding="utf-8"))
    steps = lambda x, inner: x.get(inner, [x]) if x else []
    normal, cut = steps(data["normalizer"], "normalizers"), steps(data["pre_tokenizer"], "pretokenizers")
    first = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} for s in normal)
    second = all(s["type"] == "Split" and r"[\p{L}]+" in s["pattern"].get("Regex", "") or s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s.get("use_regex", True) for s in cut)
    return first and second and not any(t["content"].isalpha() for t in data.get("added_tokens", []))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def compress(ids: np.ndarray, end_id: int, first_rule: int, rounds: int | None = None, per_round: int = RULES_A_ROUND, least: int = LEAST_COUNT):
    """(symbols, left, right, expansion) of ids (uint32) by Re-Pair; rule i is the symbol first_rule + i.

    Without a limit of rounds, no pair is left that occurs `least` times, end ids aside.
    Between rounds only pairs with a new symbol become more frequent, so a round looks at
    the places of these and of pairs that were frequent before.
    """
    seq = ids.astype(np.uint32)
    left, right = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    bits = max(10, min(20, int(len(seq)).bit_length()))
    live = np.ones(len(seq), bool)  # places whose pair, with the next symbol, may be frequent
    live[-1:] = False
    ends = np.flatnonzero(seq == end_id)
    live[ends] = live[ends[ends > 0] - 1] = False
    done, stuck = 0, False
    while rounds is None or done < rounds:
        done += 1
        near = np.flatnonzero(live)
        if len(near) < least:
            break
        a, b = seq[near], seq[near + 1]
        # pairs are counted by slots of a hash table; only frequent slots can hold frequent pairs
        slot = a * np.uint32(0x9E3779B1)
        slot += b * np.uint32(0x85EBCA77)
        slot >>= np.uint32(32 - bits)
        count = np.bincount(slot, minlength=1 << bits)
        many = (count >= least)[slot]
        live[near[~many]] = False
        near, slot = near[many], slot[many]
        code = a[many].astype(np.uint64) << np.uint64(32) | b[many]
        exact = stuck or len(near) <= len(seq) // 4
        if exact:  # a slot for each pair
            pair, slot, count = np.unique(code, return_inverse=True, return_counts=True)
        else:  # a slot stands for the pair last seen in it
            pair = np.zeros(1 << bits, np.uint64)
            pair[slot] = code
        many = np.flatnonzero(count >= least)
        if len(many) > per_round:
            many = many[np.argpartition(-count[many], per_round - 1)[:per_round]]
        chosen = np.zeros(len(pair), bool)
        chosen[many] = True
        taken = chosen[slot]
        taken &= pair[slot] == code
        at, slot = near[taken], slot[taken]
        # of pairs that overlap in a row, every other one is replaced, from the left
        start = np.ones(len(at), bool)
        start[1:] = np.diff(at) != 1
        begin = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        other = (np.arange(len(at)) - begin) % 2 == 0
        at, slot = at[other], slot[other]
        count = np.bincount(slot, minlength=len(pair))
        worth = count[slot] >= 3  # a rule used less often costs more than it saves
        at, slot = at[worth], slot[worth]
        if not len(at):
            if exact:
                break
            stuck = True  # frequent pairs may have lost their slots to others
            continue
        used = np.flatnonzero(count >= 3)
        name = np.zeros(len(pair), np.uint32)
        name[used] = first_rule + len(left) + np.arange(len(used))
        left = np.concatenate((left, (pair[used] >> np.uint64(32)).astype(np.uint32)))
        right = np.concatenate((right, (pair[used] & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
        seq[at] = name[slot]
        # the new symbols' pairs with what stands before and after them, but for end ids
        live[at] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        before = at[at > 0] - 1
        before = np.where(keep[before], before, before - 1)
        live[before] = seq[before] != end_id
        last = at + 2 >= len(seq)
        live[at] = ~last & (seq[np.minimum(at + 2, len(seq) - 1)] != end_id)
        seq, live = seq[keep], live[keep]
    return seq, left, right, expansions(left, right, first_rule)


def expansions(left: np.ndarray, right: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for. A rule's symbols are ids or earlier rules."""
    out = np.ones(len(left), np.uint32)
    l, r = left.astype(np.int64) - first_rule, right.astype(np.int64) - first_rule
    while len(out):
        new = np.where(l >= 0, out[l.clip(0)], 1) + np.where(r >= 0, out[r.clip(0)], 1)
        if (new == out).all():
            break
        out = new.astype(np.uint32)
    return out


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that symbols stand for."""
    seq = symbols.astype(np.uint32)
    if len(seq) > 2 * len(left) > 0:  # each rule is expanded once, then copied to its places
        size = expansions(left, right, first_rule).astype(np.int64)
        flat = _expand(np.arange(first_rule, first_rule + len(left), dtype=np.uint32), left, right, first_rule)
        rule = np.flatnonzero(seq >= first_rule)
        which = seq[rule] - first_rule
        n = np.ones(len(seq), np.int64)
        n[rule] = size[which]
        out = np.repeat(seq, n)
        n = size[which]
        first = np.cumsum(n) - n
        out[out >= first_rule] = flat[np.repeat((np.cumsum(size) - size)[which] - first, n) + np.arange(int(n.sum()))]
        return out
    return _expand(seq, left, right, first_rule)


def _expand(seq: np.ndarray, left: np.ndarray, right: np.ndarray, first_rule: int) -> np.ndarray:
    while True:
        rule = seq >= first_rule
        if not len(left) or not rule.any():
            return seq
        size = 1 + rule.astype(np.int64)
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        which = seq[rule] - first_rule
        out[start[~rule]] = seq[~rule]
        out[start[rule]] = left[which]
        out[start[rule] + 1] = right[which]
        seq = out


def _shards(path: str, end_id: int, first_rule: int, shard_tokens: int, rounds: int | None):
    """For mapInArrow over (id, text), sorted: the shards of a part."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids, lens, parts, size, shard, local = [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, lens, parts, size, shard, local
            tokens = np.concatenate(parts)
            symbols, left, right, expansion = compress(tokens, end_id, first_rule, rounds)
            top = max([int(a.max()) for a in (symbols, left, right) if len(a)], default=0)
            kind = "<u2" if top < 1 << 16 else "<u4"
            row = {
                "part": part, "shard": shard, "local_start": local, "n_tokens": len(tokens), "width": int(kind[-1]),
                "first_rule": first_rule, "doc_ids": ids, "doc_tokens": lens, "symbols": symbols.astype(kind).tobytes(),
                "left": left.astype(kind).tobytes(), "right": right.astype(kind).tobytes(), "expansion": expansion.astype("<u4").tobytes(),
            }
            local, shard = local + len(tokens), shard + 1
            ids, lens, parts, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        big = pa.list_(pa.int64())
        arrow = pa.schema([
            ("part", pa.int32()), ("shard", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()),
            ("first_rule", pa.int64()), ("doc_ids", big), ("doc_tokens", big), *((c, pa.binary()) for c in ("symbols", "left", "right", "expansion")),
        ])
        end = np.array([end_id], np.uint32)
        encode = encoder(path).encode
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(keys), 4096):
                tokens, counts = encode(texts[i : i + 4096])
                upto = np.cumsum(counts)
                for key, n, z in zip(keys[i : i + 4096], counts.tolist(), upto.tolist()):
                    ids.append(key)
                    lens.append(n + 1)
                    parts += (tokens[z - n : z], end)
                    size += n + 1
                    if size >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS, rounds: int | None = None,
) -> None:
    """Write the ids of docs, by ascending id, to files under path.

    tokenizer: a vocabulary file that each worker can read. Null and empty texts have the
    end id alone; null ids come first; rows of one id, repeated ones too, follow each other
    in no set order. Other columns aren't read. No rows: no shards.
    """
    import json

    vocabulary = json.load(open(tokenizer, encoding="utf-8"))
    first_rule = 1 + max([end_id, *vocabulary["model"]["vocab"].values(), *(t["id"] for t in vocabulary.get("added_tokens", []))])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DOCS_A_PART))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")
    rows.mapInArrow(_shards(tokenizer, end_id, first_rule, shard_tokens, rounds), SHARD_SCHEMA).write.parquet(path)


def _opened(row: dict):
    kind = f"<u{row['width']}"
    return tuple(np.frombuffer(row[c], "<u4" if c == "expansion" else kind) for c in ("symbols", "left", "right", "expansion"))


def starts(shards: DataFrame) -> DataFrame:
    """(part, part_start): ids of all parts before each; a row for each part."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document in the files: all ids are decoded."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                symbols, left, right, _ = _opened(row)
                ids = expand(symbols, left, right, row["first_rule"]).astype("<u4")
                assert len(ids) == row["n_tokens"] == sum(row["doc_tokens"])
                ends = np.cumsum(np.array(row["doc_tokens"], np.int64))
                first = ends - np.array(row["doc_tokens"], np.int64)
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(first + row["local_start"]),
                    pa.array(ends - first), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist())], pa.int64()),
                ], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = shards.mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts(shards.select("part", "n_tokens")), "part").select(
        "doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str, start: int, count: int) -> list[int]:
    """ids start to start + count of all parts. Only shards and symbols that hold them are read and expanded."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    at = F.col("part_start") + F.col("local_start")
    wanted = shards.join(starts(shards.select("part", "n_tokens")), "part").withColumn("at", at)
    out: list[int] = []
    for r in wanted.filter((F.col("at") < start + count) & (F.col("at") + F.col("n_tokens") > start)).orderBy("at").collect():
        symbols, left, right, expansion = _opened(r.asDict())
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= r["first_rule"]
        size[rule] = expansion[symbols[rule].astype(np.int64) - r["first_rule"]]
        ends = np.cumsum(size)
        a, b = max(0, start - r["at"]), min(r["n_tokens"], start + count - r["at"])
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left"))
        ids = expand(symbols[i : j + 1], left, right, r["first_rule"])
        skip = a - (int(ends[i - 1]) if i else 0)
        out += ids[skip : skip + b - a].tolist()
    return out


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write_tokens() to a new folder in the shared space, then read_documents() of it."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_documents(docs.sparkSession, path)
