"""Each operator against brute force, a round trip or held-out accuracy, and on the odd rows that any table may hold."""

import heapq
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracewright.llm import decontamination as dec
from tracewright.llm import exact_dedup, html_text, language, near_dedup, quality, token_counts, toxicity, warc_fixity
from tracewright.llm import sentencepiece_lattice as sp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None), (2, ""), (3, "   \t\n"), (4, "one two three four five six seven eight nine ten eleven twelve"), (5, "one two three  four five six seven eight nine ten eleven twelve"),
    (5, "one two three  four five six seven eight nine ten eleven twelve"), (None, "lost id words are here"), (6, "word " * 4000), (7, "x" * 30000), (8, "123 !!! ---"), (9, "Ünï çödé 日本語 ▁ \x00 end"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, repeated, and an extra column that clashes with names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in ODD], SCHEMA + ", h string, row_id int")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in exact_dedup.WHITE), []).append((i, t or ""))
    return groups


def test_exact_dedup(spark, odd):
    got = exact_dedup.classify_copies(odd).collect()
    assert len(got) == len(ODD)
    for members in brute_exact(ODD).values():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        own = [r for r in got if r["doc_id"] in {i for i, _ in members} and r["keep_id"] == best[0]]
        assert len(own) == len(members) and all(r["group_size"] == len(members) for r in own) and sum(r["kept"] for r in own) == 1
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(brute_exact(ODD))
    # many shards, and no filter for the rows at all, change what shuffles, not what results
    for more in ({"shard": 2}, {"max_bits": 1}):
        assert sorted(map(str, exact_dedup.classify_copies(odd, **more).collect())) == sorted(map(str, got))
        assert sorted(map(str, exact_dedup.drop_copies(odd, **more).collect())) == sorted(map(str, kept.collect()))
    none = odd.where("false")
    assert exact_dedup.classify_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_exact_dedup_ties(spark):
    """Of rows alike in text and id the same one stays, however the rows are dealt out."""
    rows = [(1, "a b", k) for k in range(40)] + [(2, "a  b", 0), (3, "ab", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    got = {str(exact_dedup.drop_copies(df.repartition(n, "extra")).collect()) for n in (1, 3, 7)}
    assert len(got) == 1 and "doc_id=2" in got.pop()
    one = df.where("doc_id = 1")
    assert len({str(exact_dedup.drop_copies(one.repartition(n, "extra")).collect()) for n in (1, 3, 7)}) == 1
    assert len({str(near_dedup.keep_one(one.repartition(n, "extra")).collect()) for n in (1, 3)}) == 1


def test_filters_miss_nothing(spark):
    values = [*range(500), *range(0, 500, 7), *[3] * 2000]
    df = spark.createDataFrame([(v,) for v in values], "h long").repartition(5)
    for shard in (1 << 20, 50):
        again = exact_dedup.repeated_hashes(df, "h", len(values), shard)
        found = {r["h"] for r in again.collect()}
        assert {*range(0, 500, 7), 3} <= found and len(found) < 100
        for most in (1 << 20, 1):
            among = exact_dedup.marked_among(df, df["h"], again, "h", len(found), "some", most).where("some").select("h").distinct().collect()
            assert found <= {r["h"] for r in among} and len(among) < 110


def words(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for win in [v[k : k + 10] for k in range(max(1, len(v) - 9))] if v else []:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("block", [200_000, 10])
def test_decontamination(spark, odd, block):
    rng = random.Random(3)
    items = [(1, "two three four FIVE six seven eight nine ten eleven twelve"), (2, "five six"), (3, None), (4, ""), (10, "a b c d e f g h i j k"), (11, "a b c d e f g h i j k")]
    more = [(100 + k, " ".join(rng.choice("abcdefghijk") + ("," if rng.random() < 0.1 else "") for _ in range(60)) + " a b c d e f g h i j " * (k % 2)) for k in range(20)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    # columns with names that the operator uses inside
    docs = docs.selectExpr("doc_id", "text", "1 as found", "'k' as keys", "2 as segment", "text as spans", "0 as row")
    index = dec.build_index(docs)
    got = dec.search(index, bench, block_windows=block).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    want = {dec._key(r["text"] or ""): brute_hits(r["text"], items) for r in rows}
    assert Counter((r["doc_id"], bytes(r["text_key"])) for r in got) == Counter((r["doc_id"], dec._key(r["text"] or "")) for r in rows)
    for r in got:
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), ",".join(r["items"])) == want[bytes(r["text_key"])]
    clean = dec.drop_contaminated(docs, bench, block_windows=block)
    assert clean.columns == docs.columns
    assert Counter(clean.collect()) == Counter(r for r in rows if not want[dec._key(r["text"] or "")][1])
    assert dec.search(index, bench.where("false")).where("size(items) > 0").count() == 0
    none = docs.where("false")
    assert dec.search(dec.build_index(none), bench).count() == 0 and dec.drop_contaminated(none, bench).count() == 0
    named = dec.build_index(docs.selectExpr("concat('d', doc_id) as doc_id", "text"))
    assert {r["doc_id"] for r in dec.search(named, bench).collect()} == {None if r["doc_id"] is None else f"d{r['doc_id']}" for r in rows}


def test_stored_postings(spark, odd):
    """The index holds every word of every text, and can be read without this module."""
    for r in dec.build_index(odd.coalesce(1)).collect():
        terms, counts, places = (np.frombuffer(r[c], t) for c, t in (("terms", "<u8"), ("counts", "<i4"), ("postings", "<i4")))
        texts = [{i: t for i, t in ODD}.get(i) for i in r["ids"]]
        flat = [w for t in texts for w in words(t)]
        assert [len(words(t)) for t in texts] == r["n_words"] and counts.sum() == len(places) == len(flat)
        lists = {}
        for k, w in enumerate(flat):
            lists.setdefault(w, []).append(k)
        at = np.cumsum(counts) - counts
        assert sorted(map(tuple, lists.values())) == sorted(tuple(places[a : a + n].tolist()) for a, n in zip(at, counts, strict=True))
        assert (np.diff(terms.astype(object)) > 0).all()


def test_stored_postings_come_in_small_parts(spark):
    # row groups and pages are held whole where they are written and read, so they must not grow with the rows of a task
    docs = spark.range(6, numPartitions=1).selectExpr("id as doc_id", "array_join(transform(sequence(0, 120000), x -> x * 7 + id), ' ') as text")
    index = dec.build_index(docs)
    seen = 0
    for f in index.inputFiles():
        file = pq.ParquetFile(f.removeprefix("file://"))
        for g in range(file.num_row_groups):
            group, rows = file.metadata.row_group(g), file.read_row_group(g, ["terms", "counts", "postings"])
            seen += group.num_rows
            one = max(sum(len(x) for x in r.values()) for r in rows.to_pylist())
            assert group.total_byte_size <= (1 << 22) + one + (1 << 16)
    assert seen == index.count() == 6
    bench = spark.createDataFrame([(1, " ".join(str(x * 7 + 3) for x in range(119_000, 119_010)))], "item_id long, text string")
    assert {r["doc_id"]: len(r["items"]) for r in dec.search(index, bench).collect()} == {k: int(k == 3) for k in range(6)}


def test_one_huge_item_goes_out_in_blocks(spark):
    rng = random.Random(15)
    item = text(rng, VOCABULARY, 3000)
    bench = spark.createDataFrame([(1, item), (2, item), (3, "x " * 500)], "item_id long, text string")
    blocks = [t for _, t in dec._blocks(bench, "item_id", "text", 10, 500)]
    assert len(blocks) > 10 and max(len(t.item_of) for t in blocks) < 800
    docs = spark.createDataFrame([(1, item), (2, " ".join(item.split()[500:520])), (3, "x " * 12)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in dec.search(dec.build_index(docs), bench, block_windows=500).collect()}
    assert got[1]["spans"] == [(0, 3000)] and got[2]["spans"] == [(0, 20)] and got[3]["spans"] == [(0, 12)]
    assert got[1]["items"] == got[2]["items"] == ["1", "2"] and got[3]["items"] == ["3"]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "delta gamma"), (4, "alpha beta y z q w gamma delta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    index = dec.build_index(docs)
    assert {(r["doc_id"], r["exact"]) for r in dec.matches(index, bench).collect()} == {(1, True)}
    got = {r["doc_id"]: r["exact"] for r in dec.matches(index, bench, slop=1).collect()}
    assert got.keys() == {1, 2} and got[1] and not got[2]


def test_proximity_stays_in_its_document(spark):
    bench = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    # the document before ends with a term of the item; the rarest term stands nearer to the start than in the item
    for rows, slop, want in (([(1, "x alpha"), (2, "alpha beta gamma delta")], 1, (2, 0, True)), ([(1, "x alpha gamma delta"), (2, "beta alpha gamma delta")], 2, (2, -1, False))):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert {(r["doc_id"], r["start"], r["exact"]) for r in dec.matches(dec.build_index(docs), bench, slop=slop).collect()} == {want}


def text(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


VOCABULARY = ["".join(random.Random(k).choices("aeioubcdfglmnprst", k=random.Random(k).randint(2, 8))) for k in range(4000)]


def plain_kmers(text):
    """Five-word tuples, each with the number of equal ones before it."""
    w, seen, out = words(text), Counter(), []
    for k in [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []:
        out.append((k, seen[k]))
        seen[k] += 1
    return out


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def similar(a, b):
    """The longest common subsequence by the textbook, where sizes and sets allow 0.8 at all."""
    if not a or not b or len(set(a) & set(b)) < 0.8 / 1.8 * (len(a) + len(b)) - 1e-9:
        return False
    m = common_subsequence(a, b)
    return m / (len(a) + len(b) - m) >= 0.8 - 1e-12


def brute_classes(rows):
    own = [plain_kmers(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and (own[a] == own[b] != [] or similar(own[a], own[b])):
                root[find(a)] = find(b)
    out = {}
    for k in range(len(rows)):
        out.setdefault(find(k), []).append(k)
    return list(out.values())


def test_alignment():
    """Against the textbook, at and around the threshold, with moved and repeated parts."""
    rng = random.Random(12)
    kmers = lambda t: near_dedup.labelled_kmers(near_dedup.words_of(pa.array([t], pa.large_string())))[0]
    hits = 0
    for _ in range(400):
        base = text(rng, VOCABULARY[: rng.choice([3, 30, 3000])], rng.randint(1, 60)).split()
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            at, n = rng.randrange(len(copy) + 1), rng.randint(0, 3)
            copy[at : at + n] = rng.choice([[], ["new"], copy[:2], base[-3:]])
        a, b = " ".join(base), " ".join(copy)
        want = similar(plain_kmers(a), plain_kmers(b))
        x, y = kmers(a), kmers(b)
        assert (near_dedup.aligned(x, y) > 0) == want, (a, b)
        hits += want
        if want:
            bits = np.unpackbits((near_dedup.signature(x, near_dedup.MARK) ^ near_dedup.signature(y, near_dedup.MARK)).view(np.uint8)).sum()
            assert bits <= (len(x) + len(y)) / 9 + 1e-6
    assert 50 < hits < 350


def test_sketches_find_links():
    """Pairs at similarity 0.8 itself, short and long, share a sketch."""
    rng = random.Random(13)
    for n in (4, 8, 12, 16, 20, 40, 300):
        missed = 0
        for _ in range(400 if n < 100 else 60):
            kmers = np.array([rng.getrandbits(64) for _ in range(n + n // 4)], np.uint64)
            missed += not set(near_dedup.sketches_of(kmers).tolist()) & set(near_dedup.sketches_of(kmers[: n]).tolist())
        assert missed == 0, n


def test_near_dedup(spark, odd):
    rng = random.Random(5)
    rows = list(ODD)
    for g in range(12):
        base = text(rng, VOCABULARY, rng.randint(40, 400)).split()
        for c in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            rows.append((1000 + 100 * g + c, " ".join(copy)))
    extra = ", row_id int, text_key string, node long, root string, key int, some int, a int, h int, _id int"
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2, "y", 3, 4, 5, 6, 7) for i, t in rows], SCHEMA + extra)
    got = near_dedup.classify(df).collect()
    assert len(got) == len(rows)
    want = Counter()
    for members in brute_classes(rows):
        ids = [rows[k][0] for k in members]
        want.update((i, min((x for x in ids if x is not None), default=None), len(ids)) for i in ids)
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(brute_classes(rows))
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(brute_classes(rows))
    assert near_dedup.classify(df.where("false")).count() == 0 and near_dedup.keep_one(df.where("false")).count() == 0
    # ids of another type
    assert {r["class_id"] for r in near_dedup.classify(df.selectExpr("cast(doc_id as string) doc_id", "text")).collect()} == {None if i is None else str(i) for i in {min((str(rows[k][0]) for k in m if rows[k][0] is not None), default=None) for m in brute_classes(rows)}}


def test_near_dedup_chain(spark):
    """A large group in which few pairs are links still comes out as its components."""
    rng = random.Random(9)
    rows, now = [], text(rng, VOCABULARY, 150).split()
    for k in range(120):
        now = list(now)
        now[rng.randrange(150)] = rng.choice(VOCABULARY)
        rows.append((k, " ".join(now)))
    got = near_dedup.classify(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)).collect()
    want = {rows[k][0]: min(rows[j][0] for j in m) for m in brute_classes(rows) for k in m}
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_near_dedup_many_parts(spark):
    """Hot texts, buckets and components, dealt over several tasks: a large star, a common passage, copies."""
    rng = random.Random(11)
    base, passage = text(rng, VOCABULARY, 60).split(), text(rng, VOCABULARY, 50)
    rows = [(k, " ".join(base[:k % 60] + [rng.choice(VOCABULARY)] + base[k % 60 :])) for k in range(250)]
    rows += [(1000 + k, f"{passage} {text(rng, VOCABULARY, rng.randint(10, 40))}") for k in range(60)]
    rows += [(2000 + k, " ".join(base)) for k in range(150)] + [(3000, "short text of seven words is here"), (3001, "short text of seven words is here too")]
    got = near_dedup.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    want = {rows[k][0]: min(rows[j][0] for j in m) for m in brute_classes(rows) for k in m}
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_components(spark):
    rng = random.Random(14)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 450)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)] + [(900, 900)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {x: r for x, r in root.items() if x != r} == {x: r for x, r in got.items() if x != r}


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_quality(spark, odd):
    rng = random.Random(1)
    rows, y = [], []
    for k in range(300):
        good = rng.random() < 0.7
        t = text(rng, VOCABULARY, rng.randint(30, 200))
        rows.append((k, t.capitalize() + "." if good else " ".join(w.upper() + "!!" for w in t.split())))
        y.append((k, int(good), 0))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is null or doc_id < 0"))
    got = by_id(quality.classify(df, labels(spark, y)))
    held = [i for i, _, _ in y if got[i]["held_out"]]
    assert len(got) == 301 and held and all(0 <= r["score"] <= 1 for r in got.values())
    assert auc(np.array([got[i]["score"] for i in held]), np.array([y[i][1] for i in held])) > 0.98
    assert {r["score"] for r in quality.classify(odd, labels(spark, [])).collect()} == {0.5}
    assert quality.classify(odd, labels(spark, [(4, 1, 0), (8, 0, 0)])).count() == len(ODD)
    assert quality.keep_good(odd, labels(spark, [(4, 1, 0)])).columns == odd.columns


def test_additive_model_is_a_sum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y, rounds=20, pair_rounds=40, n_pairs=2)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.95


def test_language(spark, odd):
    rng = random.Random(2)
    parts = {"aa": "ba ko ti ra shi mu".split(), "bb": "sch ver ung keit lich ein".split(), "cc": "eau oux ment ière qué".split()}
    rows = []
    for k in range(240):
        lang = rng.choice(list(parts))
        rows.append((1000 + k, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 80))), lang, "s", 0))
    df = spark.createDataFrame(rows, SCHEMA).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is null or doc_id in (1, 2, 3, 8)").withColumn("lang", odd["lang"].substr(1, 0)))
    from pyspark.sql import functions as F

    df = df.withColumn("lang", F.nullif("lang", F.lit("")))
    got = by_id(language.classify(df))
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert held and sum(got[r[0]]["lang_pred"] == r[2] for r in held) / len(held) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = language.classify(df.where("lang = 'zz'").unionByName(df.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in empty.collect()} == {"und"}


def test_ppm_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([("a", "abracadabra " * 3), ("b", "banana bandana")], "lang string, text string")
    m = language.train(rows, max_contexts=50)
    assert np.allclose(np.exp2(-m.bits.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_language_keeps_every_context(spark):
    """A small language beside a large one keeps its contexts, and blocks give what one table gives."""
    rng = random.Random(9)
    pick = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))
    large = [("aa", pick(100)) for _ in range(60)]
    small = [("zz", pick(100))]
    rows = spark.createDataFrame(large + small, "lang string, text string")
    model = language.train(rows)
    # every position's whole context was met, so each costs less than in no context at all
    met = {t[max(0, k - 4) : k].rjust(4, "\0") for _, t in large + small for k in range(len(t))}
    assert len(met) > 16_000 and len({int(h) for levels in model.tables.values() for h in levels[4].context}) == len(met)
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(small + large[:5])] + [(90, None), (91, "ÿ#x"), (92, "12")], "doc_id long, text string")
    one = by_id(language.identify(docs, model, F.lit(True)))
    assert one[0]["lang_pred"] == "zz" and one[1]["lang_pred"] == "aa" and one[90]["lang_pred"] == "und"
    split = language.train(rows, block_rows=9_000)
    assert len(split.blocks) > 3
    for i, r in by_id(language.identify(docs, split, F.lit(True))).items():
        assert r["lang_pred"] == one[i]["lang_pred"] and np.allclose([r["score"], r["bits_per_byte"]], [one[i]["score"], one[i]["bits_per_byte"]], atol=1e-5)


def test_every_language_is_learnt(spark):
    """More languages than 64, the rarest with the fewest rows; in one table and in blocks of languages."""
    rng = random.Random(10)
    names = [f"l{k:02d}" for k in range(80)]
    stems = {x: ["".join(rng.choices("bcdfghklmnprstvz", k=3)) for _ in range(6)] for x in names}
    pick = lambda x: " ".join(rng.choice(stems[x]) for _ in range(30))
    rows = spark.createDataFrame([(x, pick(x)) for k, x in enumerate(names) for _ in range(1 if k % 4 == 0 else 3)], "lang string, text string")
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, pick(x)) for k, x in enumerate(names)], "doc_id long, text string")
    for size in (language.BLOCK_ROWS, 3_000):
        model = language.train(rows, block_rows=size)
        assert model.languages == names and (len(model.blocks) > 1) == (size == 3_000)
        got = by_id(language.identify(docs, model, F.lit(True)))
        assert [got[k]["lang_pred"] for k in range(80)] == names


def test_toxicity(spark, odd):
    rng = random.Random(4)
    rows, y = [], []
    for k in range(500):
        bad = rng.random() < 0.3
        w = text(rng, VOCABULARY, rng.randint(20, 200)).split()
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), "zaqwx" + rng.choice(VOCABULARY))
        rows.append((k, " ".join(w)))
        y.append((k, 1, int(bad)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is null"))
    got = by_id(toxicity.classify(df, labels(spark, y)))
    held = [i for i, _, _ in y if got[i]["held_out"]]
    assert len(got) == 501 and auc(np.array([got[i]["score"] for i in held]), np.array([y[i][2] for i in held])) > 0.97
    assert toxicity.classify(odd, labels(spark, [])).count() == len(ODD)
    assert toxicity.classify(odd, labels(spark, [(i, 1, i % 2) for i in range(1, 10)])).count() == len(ODD)


def test_toxicity_keeps_every_context(spark):
    """Against a plain Kneser-Ney over dictionaries, with more contexts than any fixed bound; in one table and in blocks."""
    rng = random.Random(6)
    pick = lambda y, n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) + ("qq" if y else "") for _ in range(n)]
    words = [(y, w) for y, n in ((0, 9000), (1, 400)) for w in pick(y, n)]
    df = spark.createDataFrame([(y, " ".join(w for z, w in words[k : k + 50] if z == y)) for k in range(0, len(words), 50) for y in (0, 1)], "kind int, text string")
    counts, grams = [Counter(), Counter()], set()
    for y, w in words:
        s = "\0" * 4 + w + "\1"
        for k in range(4, len(s)):
            grams.add(s[k - 4 : k + 1])
            for d in range(5):
                counts[y][s[k - d : k + 1]] += 1
    cont = Counter(g for d in range(4) for g in {x[-d - 2 :] for x in grams} for g in [g[1:]]) + Counter(grams)
    tables = [cont, *counts]
    cut = lambda c, d: toxicity._discount(sum(v == 1 for g, v in c.items() if len(g) == d + 1), sum(v == 2 for g, v in c.items() if len(g) == d + 1))
    cuts = [[cut(c, d) for d in range(5)] for c in tables]
    after = [{} for _ in tables]
    for c, by in zip(tables, after, strict=True):
        for g, v in c.items():
            by.setdefault(g[:-1], []).append(v)
    assert sum(len(h) > 0 for h in after[0]) > 24_000
    size = len({g[-1] for g in grams}) + 1

    def p(k, h, x):
        got = after[k].get(h)
        if got is None:
            return p(0, h, x) if k else p(0, h[1:], x)
        cut = cuts[k][len(h)]
        below = p(0, h[1:], x) if h else 1 / size
        return (max(tables[k][h + x] - cut, 0) + sum(min(v, cut) for v in got) * below) / sum(got)

    def value(word):
        s, total = "\0" * 4 + word + "\1", 0.0
        for k in range(4, len(s)):
            h = next(s[k - d : k] for d in range(4, -1, -1) if s[k - d : k] in after[0])
            total += np.log(p(2, h, s[k])) - np.log(p(1, h, s[k]))
        return total

    tests = [w for _, w in words[::977]] + pick(0, 5) + pick(1, 5)
    summed = toxicity.sum_grams(df, toxicity.word_symbols, 4)
    asked = spark.createDataFrame([(k, f"{w} {w}") for k, w in enumerate(tests)] + [(99, "!"), (98, None)], "doc_id long, text string").fillna("", "text")
    for rows in (toxicity.BLOCK_ROWS, 20_000):
        model = toxicity.model_of(summed, block_rows=rows)
        assert len(model.blocks) == 1 or rows == 20_000
        got = {r["doc_id"]: r["x"] for r in toxicity.features(asked, "doc_id long", model).collect()}
        assert got[99] == got[98] == [0.0] * 4
        for k, w in enumerate(tests):
            assert np.allclose(got[k], [value(w) / (len(w) + 1), value(w), value(w), 0], atol=1e-3)


def brute_paths(m, chunk):
    into = {}
    for start, end, s, ids in m.arcs(chunk):
        into.setdefault(end, []).append((start, s, ids))

    def paths(end):
        if end == 0:
            yield 0.0, ()
        for start, s, ids in into.get(end, ()):
            for t, head in paths(start):
                yield t + s, (*head, *ids)

    return heapq.nlargest(5, paths(len(chunk)))


def test_sentencepiece(spark, odd):
    m = sp.lattice(sp.MODEL)
    for t in ["hello a", "a b", "interest", "x\ny z", " two", "日本 q", "aaaaaa"]:
        whole = (" " + t).replace(" ", sp.SPACE)
        assert [round(s, 6) for s, _ in m.encode(t, 5)] == [round(s, 6) for s, _ in brute_paths(m, whole)], t
    rng = random.Random(16)
    seen = Counter()
    for _ in range(300):
        t = "".join(rng.choice(["a", "bc ", " ", "é", "日", "the", "\n"]) for _ in range(rng.randint(1, 12)))
        (_, a), *rest = m.encode(t, 4)
        for b in [x for _, x in rest] + [m.encode(t + rng.choice(["", "a", "日"]))[0][1]]:
            seen[same := m.decode(a) == m.decode(b)] += 1
            assert m.decodes_alike(a, b) == same
    assert min(seen[True], seen[False]) > 50
    fresh = sp.Lattice.load(sp.MODEL)
    chunks = [c for c in {c for w in VOCABULARY[:300] for c in m.chunks(w + " Éà日")} if len(c) < 64]
    fresh.learn(sorted(chunks))
    for c in chunks:
        a, b = fresh.held(c), m.chunk(c)
        assert a[1] == b[1] and a[0] == pytest.approx(b[0]) and (a[2] == b[2] or a[2] == pytest.approx(b[2]))
    rows = sp.encode(odd).collect()
    for (_, t), r in zip(ODD, rows, strict=True):
        assert all(m.decode(s["ids"]) == (t or "") for s in r["segmentations"])
        scores = [s["score"] for s in r["segmentations"]]
        assert scores == sorted(scores, reverse=True) and 1 <= len(scores) <= sp.N_BEST
    back = sp.decode(sp.encode(odd).selectExpr("doc_id", "segmentations[0].ids ids"), "ids").collect()
    assert [r["text"] for r in back] == [t or "" for _, t in ODD]
    brief = sp.summarise(odd).collect()
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in brief) and [m.decode(r["ids"]) for r in brief] == [t or "" for _, t in ODD]
    import zlib

    for r, whole in zip(brief, rows, strict=True):
        assert r["ids"] == whole["segmentations"][0]["ids"] and r["scores"] == [s["score"] for s in whole["segmentations"]]
        assert r["ids_crc32"] == [zlib.crc32(np.array(s["ids"], "<i4").tobytes()) for s in whole["segmentations"]] and len(set(r["ids_crc32"])) == len(r["scores"])
    assert sp.summarise(odd.where("false")).count() == 0


def test_token_tree_follows_edits():
    enc = token_counts.encoder(token_counts.RANKS)
    rng = random.Random(6)
    for _ in range(400):
        now = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'", "s", "12", "é", "!", "\t"]) for _ in range(rng.randrange(0, 500)))
        tree = token_counts.TokenTree(now, enc)
        for _ in range(4):
            a = rng.randrange(len(now) + 1)
            b = min(len(now), a + rng.choice([0, 1, 3, 200]))
            new = rng.choice(["", " ", "x", "\n\n", "'s", " new words", "a" * 60, "日本 12"])
            tree.edit(a, b, new)
            now = now[:a] + new + now[b:]
            assert tree.text() == now and tree.n_tokens == len(enc.encoding.encode_ordinary(now))
    tree = token_counts.TokenTree("some words " * 5000, enc)
    tree.edit(20000, 20004, "other")
    assert tree.reencoded < 60


def test_token_counts(spark, odd):
    enc = token_counts.encoder(token_counts.RANKS)
    got = token_counts.count_tokens(odd).collect()
    assert [r["n_tokens"] for r in got] == [len(enc.encoding.encode_ordinary(t or "")) for _, t in ODD]
    assert token_counts.count_tokens(odd.where("false")).count() == 0


PAGE = "<html><head><title>T</title><script>var a='</p>';</script></head><body><header><a href=/>Home</a></header><nav><ul><li>M{k}<li>N</ul></nav><div class='cookie-notice'>We use cookies</div>{body}<aside>Side {k}</aside><div id=comments><p>First! {k}</p></div><footer>&copy; x {k}</footer></body></html>"
BODIES = ["<article><h1>A &amp; {k}</h1><p>One <b>two{k}<br>three<p>Four  \n five&nbsp;{k}<form>Mail<input></form></article>", "<main><h2>A &amp; {k}</h2><ul><li>One two{k} three<li>Four five {k}</ul></main>", "<div class=story><h1>A &amp; {k}</h1><p>One two{k} three</p><p>Four five {k}</p></div>"]


@pytest.mark.parametrize("body", BODIES)
def test_html(spark, body):
    rows = [(k, f"http://h.example/{k}", (PAGE.replace("{body}", body)).replace("{k}", str(k))) for k in range(9)]
    rows += [(50, None, None), (51, "http://h.example/x", ""), (52, "http://other.example/", "plain &lt;text&gt;\n here"), (52, "http://other.example/", "plain &lt;text&gt;\n here"), (None, "http://h.example/0", "<p>a<p>b")]
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = {50: "", 51: "", 52: "plain <text> here", None: "a\nb"}.get(r["page_id"], f"A & {r['page_id']}\nOne two{r['page_id']} three\nFour five {r['page_id']}")
        assert r["text"] == want and r["n_chars"] == len(want)


def pages_of(spark, htmls, host="h.example"):
    return spark.createDataFrame([(k, f"http://{host}/{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")


def main_of(spark, htmls):
    return [r["text"] for r in sorted(html_text.main_texts(pages_of(spark, htmls)).collect(), key=lambda r: r["page_id"])]


def test_wrapper_tells_template_from_content(spark):
    """A constant paragraph is template; headings, items and texts that only some pages share are content."""
    page = "<body><div class='x'><article><h2>Ingredients</h2><ul><li>Salt</ul><p>Text number {k} is here</p><p>{some}</p><p>Share this story now</p></article></div></body>"
    # the shared line is on most of any eight pages, but on fewer than four in five of all
    htmls = [page.replace("{k}", str(k)).replace("{some}", "Shared by some" if k % 4 else f"Own line {k}") for k in range(60)]
    got = main_of(spark, htmls)
    assert got == [f"Ingredients\nSalt\nText number {k} is here\n" + ("Shared by some" if k % 4 else f"Own line {k}") for k in range(60)]
    # many copies of one page are one page
    assert set(main_of(spark, [htmls[0]] * 30 + htmls[1:3])[:30]) == {"Ingredients\nSalt\nText number 0 is here\nOwn line 0\nShare this story now"}


@pytest.mark.parametrize("name", ["site has-sidebar", "content-with-banner", "no-ads", "page-wrapper"])
def test_marks_around_the_article_say_nothing(spark, name):
    article = "<article><h1>Title {k}</h1><p class='notice-board'>One {k} <a class='comment-link' href='#'>two</a> <span class='ad'>three</span></p><div class='ad-slot'>Buy {k}</div><p class='advert'>Buy {k}</p></article>"
    for inner in (article, article.replace("article", "div")):
        htmls = [f"<body><nav>Menu</nav><div class='{name}'>{inner}<div class='sidebar'>Side {{k}}</div></div></body>".replace("{k}", str(k)) for k in range(6)]
        assert main_of(spark, htmls) == [f"Title {k}\nOne {k} two three" for k in range(6)]
        assert [html_text.extract(h) for h in htmls] == [f"Title {k}\nOne {k} two three" for k in range(6)]


def test_heading_beside_the_text(spark):
    htmls = [f"<body><div class=page><h1>Title {k}</h1><div class=text>Long words of page {k} without any paragraph</div></div><div class=box>Box</div></body>" for k in range(6)]
    assert main_of(spark, htmls) == [f"Title {k}\nLong words of page {k} without any paragraph" for k in range(6)]


def test_page_inside_a_form(spark):
    htmls = [f"<body><form action=x><div><h1>Title {k}</h1><p>Words of page {k}</p><form class=search>Find</form></div></form></body>" for k in range(5)]
    assert main_of(spark, htmls) == [f"Title {k}\nWords of page {k}" for k in range(5)]


def test_two_layouts_of_a_host(spark):
    one = "<body><div class=story><h1>A {k}</h1><p>Long words of story {k} and more of them</p></div><div class=box>Box text</div></body>"
    two = "<body><section class=review><p>Review {k} with some words of its own</p><p>Read our rules first</p></section></body>"
    htmls = [(one if k % 5 else two).replace("{k}", str(k)) for k in range(40)]
    assert main_of(spark, htmls) == [f"A {k}\nLong words of story {k} and more of them" if k % 5 else f"Review {k} with some words of its own" for k in range(40)]


def test_deep_and_large_pages(spark):
    """Time and memory grow with the page, not with its square."""
    deep = "<div>" * 100_000 + "deep words" + "</div>" * 100_000
    wide = "<body><article>" + "".join(f"<p>Paragraph {k}</p>" for k in range(20_000)) + "</article></body>"
    loose = "<div>" * 20_000 + "</b>" * 20_000 + "end" + "</span>" * 1000
    import time

    start = time.time()
    assert [html_text.extract(x).count("\n") for x in (deep, wide, loose)] == [0, 19_999, 0]
    assert time.time() - start < 20
    assert main_of(spark, [deep, deep.replace("deep", "low"), wide, loose]) == [html_text.extract(x) for x in (deep, deep.replace("deep", "low"), wide, loose)]


def test_html_odd_tables(spark):
    df = pages_of(spark, ["<p>a", None, ""])
    assert html_text.main_texts(df.where("false")).count() == 0
    named = df.selectExpr("concat('p', page_id) page_id", "url", "html", "1 as host", "2 as mark", "'x' as text", "3 as group", "4 as path")
    assert {(r["page_id"], r["text"]) for r in html_text.main_texts(named).collect()} == {("p0", "a"), ("p1", ""), ("p2", "")}


def test_matching_is_the_largest():
    """Against all alignments of small trees, by brute force."""
    rng = random.Random(17)

    def grow(depth, path):
        t = html_text.Tree(path, 0, depth)
        t.children = [grow(depth + 1, path * 4 + rng.randint(1, 3)) for _ in range(rng.randint(0, 3 if depth < 3 else 0))]
        return t

    def most(x, y):
        def lists(p, q):
            if not p or not q:
                return 0
            best = max(lists(p[1:], q), lists(p, q[1:]))
            return max(best, most(p[0], q[0]) + lists(p[1:], q[1:])) if p[0].path == q[0].path else best

        return 1 + lists(x.children, y.children)

    for _ in range(100):
        a, b = grow(0, 1), grow(0, 1)
        got = html_text.match(a, b)
        assert len(got) == most(a, b) and all(x.path == y.path for x, y in got)


def test_fixity(spark):
    rows = [(k, f"http://x/{k}", "page " * (k % 7)) for k in range(300)] + [(None, None, None), (7, "http://x/7", "again"), (7, "http://x/7", "again")]
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame(rows, schema).repartition(5)
    assert {r["status"] for r in warc_fixity.audit(pages, pages).collect()} == {"ok"}
    other = [(i, u, "bad" if i == 40 else h) for i, u, h in rows if i != 41] + [(999, "http://x/999", "new")]
    got = {(r["id"], r["status"]) for r in warc_fixity.audit(pages, spark.createDataFrame(other, schema)).collect() if r["status"] != "ok"}
    assert got == {(40, "corrupt"), (41, "missing"), (999, "extra")}
    # only the branches that differ are compared
    n = 301
    own = warc_fixity.manifest(pages)
    from pyspark.sql import functions as F

    leaves = own.select("seq", "hash", F.col("byte_offset").alias("start"), (F.col("byte_offset") + F.col("length")).alias("end"))
    bad = leaves.withColumn("hash", F.when(F.col("seq") == 17, "x").otherwise(F.col("hash")))
    suspects, compared = warc_fixity.differing(warc_fixity.levels(leaves, n), warc_fixity.levels(bad, n))
    assert [r["seq"] for r in suspects.collect()] == [17] and sum(compared) <= 1 + 2 + 16 + 16
    ends = {r["end"]: r["start"] for r in leaves.collect()}
    assert sorted(ends.values())[0] == 0 and set(ends.values()) - {0} <= set(ends)
    assert warc_fixity.audit(pages.where("false"), pages.where("page_id < 3")).count() == 3


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a brute-force version of its decision."""
    import corpus_pipeline as cp

    rng = random.Random(8)
    rows = [(k, text(rng, VOCABULARY, rng.randint(40, 120)).capitalize() + ".", "en", "s", 0) for k in range(60)]
    junk = [(100 + k, " ".join(w.upper() + "!!" for w in text(rng, VOCABULARY, 50).split()), "en", "s", 0) for k in range(20)]
    item = text(rng, VOCABULARY, 14)
    rows += junk + [(200, rows[0][1].replace(" ", "  "), "en", "s", 0), (201, rows[1][1] + " tail", "en", "s", 0), (202, rows[2][1] + " " + item, "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    labels(spark, [(r[0], 0 if 100 <= r[0] < 120 else 1, 0) for r in rows]).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = {r["doc_id"] for r in cp.run(spark, d).collect()}
    # 200 has more code points than 0; 201 is a near copy of 1; 202 holds the item
    assert out == {r[0] for r in rows} - {r[0] for r in junk} - {0, 201, 202}
