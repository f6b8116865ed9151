import collections
import itertools
import math
import random
import sys
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from tidelake.llm import credentials, divergence, line_edit, merge_count, mixing, queries, rule_ensemble, simhash, suffix_blocks, token_files, winnowing  # noqa: E402

WORDS = "alpha beta gamma delta Echo FOXTROT golf hotel india été über Ñandú x1 42 kilo lima mike nov".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, id long, score double, fp long, key int, items string"


def some_text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\n", ". ", "\t"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """Rows with nulls, empty and long texts, copies, near copies, repeated rows and extra columns of clashing names."""
    rng = random.Random(3)
    base = [some_text(rng, rng.randint(1, 120)) for _ in range(60)]
    texts = base + [base[0], base[1] + " more", base[2].replace("alpha", "beta", 1), None, "", " \n\t", "one", "two words", some_text(rng, 6000), base[5] * 3]
    texts += ["user: bob password=hunter22 https://db.example.org/x", "secret='abcdef1' AKIA" + "Z9" * 8 + " " + "ab12" * 8, "token=secret=abcdefgh token:token: abcdefg", "pass: qwertyuiop " + "x " * 300 + "login=alice"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "s2", None]), None, "w", -1, 0.5, 7, 3, "i") for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, base[7], "en", "s1", 1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def df(spark, docs):
    return spark.createDataFrame(docs, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash_matches_brute_force(df, docs, empty, monkeypatch):
    for hot in (simhash.HOT_BUCKET, 1):
        monkeypatch.setattr(simhash, "CROWDED", 1000 if hot > 1 else 1)
        got = simhash.near_duplicates(df, hot=hot).collect()
        assert len(got) == len(docs)
        prints = {r["fp"] & (1 << 64) - 1 for r in got}
        group = {p: p for p in prints}
        changed = True
        while changed:
            changed = False
            for a in prints:
                for b in prints:
                    if (a ^ b).bit_count() <= 3 and group[a] > group[b]:
                        group[a], changed = group[b], True
        least = collections.defaultdict(lambda: None)
        for r in got:
            g = group[r["fp"] & (1 << 64) - 1]
            if r["id"] is not None and (least[g] is None or r["id"] < least[g]):
                least[g] = r["id"]
        assert all(r["component_id"] == least[group[r["fp"] & (1 << 64) - 1]] for r in got)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and simhash.near_duplicates(kept).count() == simhash.near_duplicates(kept).select("component_id").distinct().count()


def test_dense_fingerprints_stay_connected(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    fps = list({base ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(150)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    from tidelake.llm.common import connected_components

    for hot in (3, 1000):
        found = connected_components(simhash.links(frame, hot)).collect()
        group = {f: f for f in fps}
        changed = True
        while changed:
            changed = False
            for a in fps:
                for b in fps:
                    if (a ^ b).bit_count() <= 3 and group[a] > group[b]:
                        group[a], changed = group[b], True
        assert {r["node"]: r["root"] for r in found} == {f: g for f, g in group.items() if list(group.values()).count(g) > 1}


def test_rules_learn_and_compile(spark, df, empty):
    rng = np.random.default_rng(0)
    x = rng.random((1500, len(rule_ensemble.STATS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] < 0.7)).astype(float)
    model = rule_ensemble.fit(x[:1000], y[:1000])
    assert ((model.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.97
    assert 0 < len(model.rules) < 200
    got = rule_ensemble.scored(df, model, out="s")
    stats = np.array([rule_ensemble.statistics(r["text"].encode() if r["text"] is not None else None) for r in got.collect()])
    assert np.allclose([r["s"] for r in got.collect()], model.score(stats))
    assert rule_ensemble.scored(empty, model).collect() == []
    none = rule_ensemble.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert rule_ensemble.scored(df.limit(1), none, out="s").first()["s"] == pytest.approx(0.5)
    one = rule_ensemble.train(df, spark.createDataFrame([(0, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int"))
    assert not one.rules


def test_mixing(spark, df, docs, empty):
    got = mixing.mix(df).collect()
    assert len(got) == len(docs) and mixing.mix(empty).collect() == []
    size = {s: sum(len(plain.words(t)) for _, t, _, q, *_ in docs if q == s) for s in ("s1", "s2", None)}
    total, weight = sum(size.values()), {"s1": 5, "s2": 2, None: 1}
    target, free = {}, set(size)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[q] for q in free) for s in free}
        full = [s for s in free if share[s] > 3 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * size[s]
            free.discard(s)
    for s in size:
        rows = [r for r in got if r["source"] == s]
        assert all(r["mix_target"] == pytest.approx(target[s]) and r["mix_source_size"] == size[s] and 0 <= r["mix_copies"] <= 3 for r in rows)
        assert abs(sum(r["mix_taken"] for r in rows) - target[s]) <= max(r["mix_size"] for r in rows)
    assert sorted((r["doc_id"] or -1, r["mix_taken"]) for r in got) == sorted((r["doc_id"] or -1, r["mix_taken"]) for r in mixing.mix(df.repartition(5)).collect())


def test_mixing_of_full_sources_and_extra_columns(spark):
    rows = [(i, "", "a", 1) for i in range(60)] + [(100 + i, "w " * (i % 5), "a", 1) for i in range(40)] + [(200 + i, "w " * 40, "b", 1) for i in range(50)]
    rows += [(300 + i, "# $ % & w" if i % 7 else "words of a good text", "c", 1) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, epochs int")
    frame = frame.withColumns({"mix_source_size": F.lit("x"), "rest": F.lit(1), "size": F.lit(2), "range": F.lit(3), "s": F.lit(4)})
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows) and [c for c in mixing.mix(frame).columns if c == "mix_source_size"] and all(r["epochs"] == 1 and r["rest"] == 1 for r in got)
    assert max(r["mix_copies"] for r in got) == 3 and all(r["mix_copies"] == 3 for r in got if r["source"] == "a")
    for s in "abc":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["mix_taken"] for r in mine) - mine[0]["mix_target"]) <= max(r["mix_size"] for r in mine)
    # the last epoch takes the smallest keys of the source
    keys = {r["doc_id"]: r["k"] for r in frame.select("doc_id", (-F.log((F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("17"), F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))) / mixing.quality_column(F.col("text"))).alias("k")).collect()}
    for s in "bc":
        some = sorted({r["mix_copies"] for r in got if r["source"] == s})
        assert len(some) <= 2
        if len(some) == 2:
            assert max(keys[r["doc_id"]] for r in got if r["source"] == s and r["mix_copies"] == some[1]) < min(keys[r["doc_id"]] for r in got if r["source"] == s and r["mix_copies"] == some[0])


def test_token_files(spark, df, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    out = str(tmp_path / "t")
    token_files.write_tokens(df, out, path, shard_tokens=500)
    got = sorted(token_files.read_documents(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    ids, by_id, at = [], collections.defaultdict(list), 0
    for r in rows:
        by_id[r[0]].append(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        mine = next(a for a in by_id[r["doc_id"]] if zlib.crc32(a.tobytes()) == r["ids_crc32"] and len(a) == r["n_tokens"])
        ids += mine.tolist()
    for start, n in ((0, 10), (777, 1500), (len(ids) - 3, 3)):
        assert token_files.read_ids(spark, out, start, n) == ids[start : start + n]
    assert token_files.encoded(empty, path).collect() == []
    data = np.array([5, 6] * 500 + [1] + [7] * 301 + [5, 6, 7, 1], np.uint32)
    symbols, left, right, expansion = token_files.compress(data, 1, 100, rounds=5)
    assert (token_files.expand(symbols, left, right, 100) == data).all() and len(symbols) < len(data) / 4
    assert len(expansion) == len(left) and not (left == 1).any() and not (right == 1).any()


def test_token_compression_of_production():
    rng = np.random.default_rng(5)
    end, first, least = 1, 50_000, token_files.LEAST_COUNT
    passage = rng.integers(5, first, 300)
    copies = np.tile(np.append(passage, end), 2000)
    run = np.append(np.full(100_000, 7), end)
    # more kinds of frequent pairs than slots of the hash table
    crowded = np.concatenate([np.tile(np.append(rng.permutation(np.arange(5, 205)), end), 10) for _ in range(20)])
    for data, shrinks in ((copies, 100), (run, 1000), (crowded, 1.5), (rng.integers(5, 9, 20_000), 1.5), (np.zeros(0), 0), (np.array([9]), 0)):
        symbols, left, right, expansion = token_files.compress(data.astype(np.uint32), end, first)
        assert (token_files.expand(symbols, left, right, first) == data).all() and len(symbols) * shrinks <= len(data)
        assert [len(token_files.expand(np.array([first + i]), left, right, first)) for i in range(len(left))] == expansion.tolist()
        pairs = collections.Counter((a, b) for a, b in zip(symbols.tolist(), symbols[1:].tolist()) if end not in (a, b))
        assert max(pairs.values(), default=0) < least


def test_encoder_forgets_and_knows_again(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(7)
    words = ["don't", "x1", "Été", "a<|endoftext|>b", "<|startoftext|>", "ab.cd", "\u0130x", "e\u0301a", "\u3000z\u3000", "é", "''s", "\x1cq", "_a-b"] + ["".join(rng.choice("abcdeEé.1'") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    one = token_files.Encoder(path)
    assert one.letters is not None
    for _ in range(6):
        texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(rng.randrange(40))) for _ in range(30)] + [None, "", " "]
        ids, counts = one.encode(pa.array(texts))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_suffix_dedup(df, docs, empty):
    want = plain.op5([(r[0], r[1]) for r in dict.fromkeys((d[0], d[1]) for d in docs if d[0] is not None)])
    got = suffix_blocks.dedup_bytes(df, keep_text=False).collect()
    assert len(got) == len(docs)
    for r in got:
        if r["id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"].hex()) == want[r["id"]]
        else:
            assert r["n_removed"] == 0
    whole = {r["id"]: bytes(r["kept"]) for r in suffix_blocks.dedup_bytes(df).collect()}
    import hashlib

    assert all(hashlib.sha256(t).hexdigest() == want[i][3] for i, t in whole.items() if i is not None)
    assert suffix_blocks.dedup_bytes(empty).collect() == []


def test_suffix_dedup_of_random_strings(spark, monkeypatch):
    monkeypatch.setattr(suffix_blocks, "BLOCK_BYTES", 300)
    rng = random.Random(9)
    passage = "".join(rng.choice("ab c") for _ in range(400))
    rows = []
    for i in range(60):
        a = rng.randrange(350)
        rows.append((i, "".join(rng.choice("abcd é") for _ in range(rng.randrange(120))) + passage[a : a + rng.randrange(30, 200)] + "=" * rng.choice([0, 0, 70]) + passage[: rng.randrange(60)]))
    want = plain.op5(rows)
    got = suffix_blocks.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"].hex()) for r in got} == want


def test_line_dedup(spark, empty):
    rows = [
        (1, "this is a common line of text\nshort\nanother line that stands alone here"), (2, "this is a comon line of text\nshort\n\n  \nsomething else that is long"),
        (3, "this is a completely different\nthis is a common line of texts!"), (4, None), (5, ""), (6, "another line that stands alone here"), (None, "short\nshort"),
    ]
    got = {r["doc_id"]: r for r in line_edit.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("line", F.lit(1))).collect()}
    assert [(got[i]["n_lines"], got[i]["n_removed"], got[i]["n_links"]) for i in (1, 2, 3, 4, 5, 6, None)] == [(3, 1, 2), (3, 2, 1), (2, 1, 1), (0, 0, 0), (0, 0, 0), (1, 1, 0), (2, 1, 0)]
    assert got[2]["kept_text"] == "\n  \nsomething else that is long" and got[4]["kept_text"] == ""
    assert line_edit.dedup_lines(empty).collect() == []


def bound(a, b):
    """The edits allowed between two lines."""
    return next((e for e, least, most in line_edit.CLASSES if least <= min(len(a), len(b)) <= most), 0)


def close(lines):
    return {(a, b) for a in lines for b in lines if a != b and bound(a, b) and plain.lev(a, b, bound(a, b)) <= bound(a, b)}


def found_links(spark, lines, **how):
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    names = {(r["h1"], r["h2"]): r["line"] for r in line_edit._named(frame).collect()}
    got = [(names[r["h1"], r["h2"]], names[r["o1"], r["o2"]]) for r in line_edit.line_links(frame, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("how", [{}, {"hot": 1}, {"broadcast_keys": 0}])
def test_line_links_lose_nothing(spark, how):
    rng = random.Random(4)
    lines = []
    for _ in range(60):
        base = "".join(rng.choice("abcé ") for _ in range(rng.choice([7, 8, 9, 12, 15, 16, 17, 18, 20, 25, 29])))
        for _ in range(4):
            s = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(s))
                s[k : k + rng.randrange(2)] = rng.choice(["", "z", "é"])
            lines.append("".join(s))
    want = close(set(lines))
    assert found_links(spark, lines, **how) == want and len(want) > 100 and {bound(a, b) for a, b in want} == {1, 2}


def test_family_of_near_copies(spark):
    rng = random.Random(6)
    base, lines = [rng.choice("abcdé ") for _ in range(120)], set()
    for _ in range(60):  # whole words differ, or few characters
        s = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            k = rng.randrange(len(s))
            s[k : k + rng.choice([0, 1, 1, 2, 5])] = rng.choice(["", "z", "é", "yz", "uvwxy"])
        lines.add("".join(s))
    want = close(lines)
    assert found_links(spark, sorted(lines), hot=2) == want and len(want) > 100


def test_bounded_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("abé𝐚") for _ in range(rng.randrange(3, 14)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "b"])
        rows.append((a, "".join(b)))
    frame = spark.createDataFrame(rows, "x string, y string").select("x", "y", F.split("x", "").alias("a"), F.split("y", "").alias("b"), F.length("x").alias("__size_a"), F.length("y").alias("n"))
    for edits in (1, 2, 3):
        near = frame.filter((F.abs(F.col("__size_a") - F.col("n")) <= edits) & (F.least("__size_a", "n") >= edits))
        for r in near.select("x", "y", line_edit.bounded_distance("a", "b", edits).alias("d")).collect():
            d = plain.lev(r["x"], r["y"], 20)
            assert r["d"] == d if d <= edits else r["d"] > edits


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(3, 24))) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(12)):
            s = list(rng.choice(pool + [" ", ""]))
            if s and rng.random() < 0.4:
                s[rng.randrange(len(s))] = rng.choice("abcdx")
            lines.append("".join(s))
        rows.append((i if i % 9 else None, "\n".join(lines)))
    rows += [(100, "x y z same\nsame line again and again\nsame line again and again"), (100, "same line again and again\nother")]  # one id, two texts
    rows += [rows[3], rows[3]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = {r[0]: r[1] & (1 << 30) - 1 for r in frame.select("text", F.xxhash64("text")).distinct().collect()}
    places = sorted({(i is not None, i or 0, marks[t], k, t, x) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip()})
    want = {}
    distinct = {x for *_, x in places}
    linked = collections.Counter(a for a, _ in close(distinct))
    seen = []
    for some, i, _, k, t, x in places:
        copy = any(x == y or (bound(x, y) and plain.lev(x, y, bound(x, y)) <= bound(x, y)) for y in seen)
        seen.append(x)
        w = want.setdefault((i if some else None, t), [0, 0, 0, t.split("\n")])
        w[0], w[1], w[2] = w[0] + 1, w[1] + copy, w[2] + linked[x]
        if copy:
            w[3][k] = None
    for how in ({}, {"hot": 1, "broadcast_keys": 0}):
        got = line_edit.dedup_lines(frame.withColumn("line", F.lit(1)).withColumn("size", F.lit("s")), **how).collect()
        assert len(got) == len(rows)
        for r in got:
            n, removed, links, kept = want.get((r["doc_id"], r["text"]), [0, 0, 0, r["text"].split("\n")])
            assert (r["n_lines"], r["n_removed"], r["n_links"], r["kept_text"]) == (n, removed, links, "\n".join(x for x in kept if x is not None))
    with pytest.raises(TypeError):
        line_edit.dedup_lines(frame.withColumn("doc_id", F.lit("a")))


def test_secrets(df, docs, empty):
    found = credentials.scan(df).select("id", *(F.size(k).alias(k) for k in ("assign", "access", "hex")), F.sha2(credentials.listing(("assign", "access", "hex")), 256).alias("h"), credentials.listing(credentials.KINDS).alias("all")).collect()
    assert sorted(tuple(r)[1:5] for r in found) == sorted(plain.op7(r[1]) for r in docs)
    by_id = {r["id"]: r["all"] for r in found}
    by_text = {r[1]: by_id[r[0]] for r in docs if r[0] is not None}
    linked = next(v for t, v in by_text.items() if t and t.startswith("user: bob"))
    assert "linked_id:0:9" in linked and "linked_endpoint" in linked
    apart = next(v for t, v in by_text.items() if t and t.startswith("pass: qwe"))
    assert apart == ""  # parts too far from each other
    assert credentials.scan(empty).collect() == []


def test_many_spans(spark):
    text = "".join(f"é token={'q' * (i % 9)}x " for i in range(700))
    r = credentials.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("assign"), F.sha2(credentials.listing(("assign", "access", "hex")), 256)).first()
    assert (r[0], r[1]) == (plain.op7(text)[0], plain.op7(text)[3])


def test_divergence(spark, df, docs, empty):
    found = divergence.judged(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, found)) == sorted(plain.op8(r[1]) for r in docs)
    assert divergence.judged(empty).collect() == []
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice(["the", "of", "and", "to", "in", "sea", "ship", "wind"]) + rng.choice(["", "s", "er", ".", ""]) for _ in range(200)), "en") for i in range(40)]
    odd = [(100, " ".join(rng.choice(["THE", "OF", "SEA"]) + "%%%" for _ in range(37)) + " " + " ".join(str(rng.random()) for _ in range(150)), "en")]
    kept = {r["doc_id"]: r["kept"] for r in divergence.judged(spark.createDataFrame(good + odd, "doc_id long, text string, lang string")).collect()}
    assert not kept[100] and sum(kept.values()) >= 38


def test_divergence_of_replaced_letters(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choice(["The", "of", "and", "to", "in", "sea", "ship", "wind"]) + rng.choice(["", "s", "er", ".", ""]) for _ in range(200)), "en") for i in range(40)]
    odd = [(100 + i, "".join(o if c.islower() else c for c, o in zip(good[i][1], itertools.cycle(other))), "en") for i, other in enumerate(["漢字", "\ufffd", "`", '"', "\x01"])]
    found = divergence.judged(spark.createDataFrame(good + odd, "doc_id long, text string, lang string")).collect()
    assert all(r["kept"] for r in found if r["doc_id"] < 100)
    assert all(r["class_distance"] > divergence.MAX_CLASS_DISTANCE and not r["kept"] for r in found if r["doc_id"] >= 100)
    texts = ["aÀß𝐚Ⅷ漢 \t\x0b\x85\xa0.,-x'()#[]^\\~9٣`\"", "", "Ab 1"]
    counts = divergence._with_classes(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    for r in counts:
        want = collections.Counter(
            {"Ll": "lower", "Lu": "upper"}.get(unicodedata.category(c)) or ("digit" if c in "0123456789" else "space" if c in " \t\n\x0b\f\r" else "stop" if c in ".,;:'()-" else "symbol" if c in "#*$%&|<>!?@=_+/\\^~{}[]" else "rest")
            for c in r["t"]
        )
        assert r["__classes_of"] == [want[c] for c in (*divergence.CLASSES, "rest")]
    broken = spark.sql("select cast(x'E46162C3' as string) as t")  # invalid UTF-8: no count below zero
    assert [r["__classes_of"] for r in divergence._with_classes(broken, "t").collect()] == [[2, 0, 0, 0, 0, 0, 2]]


def test_divergence_of_common_words(spark):
    rng = random.Random(6)

    def vocabulary(letters):
        words = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(1500)))
        return words, [1 / (i + 3) for i in range(len(words))]

    def text(words, n):
        return " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(*words, k=n))

    en, de = vocabulary("abcdefghijklm"), vocabulary("jklmnopqrstuvwxyz")
    rows = [(i, text(en, rng.randint(60, 300)), "en") for i in range(60)] + [(100 + i, text(de, rng.randint(60, 300)), "de") for i in range(60)]
    random_letters = " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(200))
    bad = [(200, text(de, 200), "en"), (201, text(en, 200), "de"), (202, random_letters, "en"), (203, " ".join([f"{en[0][0]} {w}" for w in en[0][:200]]), "en")]
    got = {r["doc_id"]: r for r in divergence.judged(spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i, *_ in rows)
    for i in (200, 201, 202):
        assert got[i]["word_distance"] > divergence.MAX_WORD_DISTANCE and not got[i]["kept"]
    for lang in ("en", "de"):
        counts = collections.Counter(w for _, t, l in rows + bad if l == lang for w in t.lower().split())
        top = sorted(counts, key=lambda w: (-counts[w], w))[: divergence.COMMON_WORDS]
        bins = dict(zip(top, divergence.RANKS))

        def shares(words):
            n = collections.Counter(bins.get(w, "") for w in words)
            return [n[b] / n.total() for b in [*divergence.BINS, ""]]

        q = shares(counts.elements())
        for i, t, l in rows + bad:
            if l == lang:
                p = shares(t.lower().split())
                js = sum((x and x * math.log2(2 * x / (x + y))) + (y and y * math.log2(2 * y / (x + y))) for x, y in zip(p, q)) / 2
                assert got[i]["word_distance"] == pytest.approx(math.sqrt(js), abs=1e-6)


@pytest.mark.parametrize("limit", [winnowing.BROADCAST_WORDS, 0])
def test_decontamination(spark, df, docs, empty, limit):
    rng = random.Random(8)
    items = []
    for i in range(12):
        w = plain.words(docs[rng.randrange(60)][1])
        a = rng.randrange(max(1, len(w) - 20))
        items.append((i, " ".join(w[a : a + rng.randrange(1, 25)]).upper() if i % 2 else " ".join(w[a : a + rng.randrange(10, 40)])))
    items += [(20, None), (21, ""), (22, "hotel india"), (None, "no such words anywhere"), (22, "hotel india"), (30, "alpha " * 14)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = winnowing.decontaminate(df, bench, broadcast_words=limit).select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    want = plain.op9([(r[0], r[1]) for r in docs], items)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert winnowing.decontaminate(empty, bench).collect() == []
    assert not any(r["n_hit"] for r in winnowing.decontaminate(df, bench.limit(0)).collect())


@pytest.mark.parametrize("limit", [winnowing.BROADCAST_WORDS, 0])
def test_decontamination_of_short_items_and_long_texts(spark, limit):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)]
    passage = [rng.choice(pool) for _ in range(60)]
    items = [(i, " ".join(passage[i : i + 1 + i % 14])) for i in range(30)]  # items of 1 to 14 words that share windows
    items += [(100 + i, " ".join(passage[:30])) for i in range(20)]  # many items of one text
    items += [(200 + i, " ".join(["common"] * n)) for i, n in enumerate((13, 15, 40))]
    docs = []
    for i in range(40):
        w = [rng.choice(pool) for _ in range(rng.randrange(80))]
        a = rng.randrange(55)
        w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randrange(20)]
        docs.append((i, " ".join(w)))
    docs += [(50, " ".join(["common"] * 30)), (51, " ".join(["common"] * 12)), (52, " ".join(rng.choice(pool) for _ in range(40_000)) + " " + " ".join(passage[:30])), (53, " ".join(passage[:30]))]
    docs += [(53, " ".join(passage[:30])), (53, "another text of this id")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = winnowing.decontaminate(frame, bench, broadcast_words=limit).select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    want = plain.op9(docs, items)
    assert sorted(map(tuple, got)) == sorted(want)
    for few in (winnowing.BROADCAST_FOUND, 0):
        kept = winnowing.keep_clean(frame.withColumn("items", F.lit(1)), bench, broadcast_words=limit, broadcast_found=few)
        assert kept.columns == ["doc_id", "text", "items"] and sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in want if not r[5])


def test_token_counts(df, docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = merge_count.counted(df, path).select("n_bytes", "n_tokens", "over_limit").collect()
    want = []
    for r in docs:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((len((r[1] or "").encode()), n, n > 512))
    assert sorted(map(tuple, got)) == sorted(want)
    assert merge_count.counted(empty, path).collect() == []
    merges = merge_count.Merges(path)
    for t in ("a  b", " \n c", "x<|endoftext|> y", "don't  ", "é́漢字 ٣  z", "=" * 500, "\x1c \x85 a"):
        assert merges.count(t) == len(library.encode(t, add_special_tokens=False).ids)
