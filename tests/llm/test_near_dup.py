import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.util import SF001, edge_rows, frame, words
from veilframe.llm import near_dup as nd
from veilframe.llm import scratch


def aligned(a, b):
    """Longest common subsequence, cell by cell."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def alike(a, b, least=0.8):
    """Aligned words are at least 0.8 of all words of both (never more than the words that both have)."""
    need = least / (1 + least) * (len(a) + len(b)) - 1e-9
    return bool(a and b) and (Counter(a) & Counter(b)).total() >= need and aligned(a, b) >= need


def classes(rows):
    """Connected documents by brute force over all pairs: word sequences alike by 0.8."""
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    texts = [words(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and alike(texts[i], texts[j]):
                label[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(i)
    return sorted(sorted(str(rows[i][0]) for i in g) for g in groups.values())


def run(spark, docs):
    return nd.near_duplicates(docs).orderBy("row").collect()


def grouped(rows):
    groups, alone = {}, []
    for r in rows:
        groups.setdefault(r.class_id, []).append(str(r.doc_id))
    return sorted(sorted(g) for g in groups.values()) + alone


def corpus(seed=0, originals=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(originals):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 60, 200, 900]))
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4, 12])):
            copy = list(base)
            for _ in range(len(base) // 70):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
        rows.append(" ".join(base[: len(base) // 2] + rng.choices(vocabulary, k=len(base) // 2 + 1)))
    return [(i, t) for i, t in enumerate(rows)]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = run(spark, frame(spark, rows).repartition(3).coalesce(3).select("doc_id", "text").checkpoint())
    assert grouped(got) == classes(rows)
    keep = {r.class_id: 0 for r in got}
    for r in got:
        keep[r.class_id] += r.keep
    assert set(keep.values()) == {1}


def test_edge_cases(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [*edge_rows(text), (8, text.upper()), (9, "word"), (10, "")]
    got = run(spark, frame(spark, rows))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for r in got if r.doc_id in (3, 8, None)} == {3}
    assert {r.copies for r in by[3]} == {4}  # two equal rows, one without an id, one in capitals
    assert by[9][0].class_id == 7 and by[1][0].class_id == 1 and by[2][0].class_id == 2 and by[10][0].class_id == 10
    assert sum(r.keep for r in got if r.class_id == 3) == 1
    assert run(spark, frame(spark, [])) == []


def test_removal_keeps_columns_and_one_row_of_each_class(spark):
    text = " ".join(f"a{i}" for i in range(60))
    docs = frame(spark, [(5, text), (4, text), (4, text), (6, text.replace("a30", "b")), (7, "other words")])
    left = nd.remove_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [4, 7]


def test_documents_table_links_all_similar_pairs(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert grouped(run(spark, docs)) == classes(rows)


def shared_passage(pairs=150):
    """Pairs of texts alike by more than 0.9, all mostly of one passage, by which the pairs are alike by less than 0.8."""
    rng, rows = random.Random(4), []
    passage = [f"p{i}" for i in range(261)]
    for k in range(pairs):
        own = [f"o{k}x{i}" for i in range(41)]
        copy = list(own) + [f"m{k}x{i}" for i in range(k % 3 * 15)]  # of other lengths, too
        copy[rng.randrange(5, 36)] = f"e{k}"
        rows += [" ".join(passage + own), " ".join(passage + copy)]
    return rows


def without_original(copies=80):
    """Copies of a text that isn't there, alike by about 0.8, more to those with common edits."""
    rng, rows = random.Random(5), []
    base = [f"b{i}" for i in range(200)]
    for _ in range(copies):
        copy = list(base)
        for at in rng.sample(range(4, 196, 8), 4):
            copy[at] = f"d{at}v{rng.randrange(2)}"
        rows.append(" ".join(copy))
    return rows


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    rows = list(enumerate(shared_passage() + without_original()))
    monkeypatch.setattr(nd, "BLOCK_BYTES", 20_000)  # several blocks of a bucket
    monkeypatch.setattr(nd, "MANY_PAIRS", 10)  # and two rounds
    assert grouped(run(spark, frame(spark, rows))) == classes(rows)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(0)
    k = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    parts = [k[:1000], k[100:1100], k[:900], k[2000:2100], k[:0], k[500:5000]]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    found = [np.frombuffer(x, np.uint64)[None] for x in nd.parities(np.concatenate(parts), offsets)]
    for a, p in zip(parts, found):
        for b, q in zip(parts, found):
            width = min(p.shape[1], q.shape[1])
            differ = np.bitwise_count(nd._folded(p, width) ^ nd._folded(q, width)).sum()
            assert differ <= len(np.setxor1d(a, b)) and (differ == 0) == (len(np.setxor1d(a, b)) == 0)


def test_alignment_equals_brute_force():
    rng = random.Random(7)
    for case in range(300):
        vocabulary = rng.choice([3, 30, 2000])
        a = [rng.randrange(vocabulary) for _ in range(rng.choice([1, 4, 40, 300]))]
        b = list(a)
        for _ in range(rng.randrange(1 + len(a) // 6)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = rng.choices(range(vocabulary), k=rng.randrange(3))
            b = b or [0]
        if case % 5 == 0:
            rng.shuffle(b)
        need = int(np.ceil(0.8 / 1.8 * (len(a) + len(b)) - 1e-9))
        true = aligned(a, b)
        if need <= min(len(a), len(b)):
            got = nd.common(a, b, need)
            assert got <= true and (got == true or true < need)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        marked = [nd.labelled(v, np.array([0, len(v)])) for v in (x, y)]
        assert nd.alike(x, y, *marked) == (true >= need), (case, true, need)


def test_alignment_follows_order():
    def alike(a, b):
        return nd.alike(a, b, *[nd.labelled(v, np.array([0, len(v)])) for v in (a, b)])

    a = np.arange(100, dtype=np.uint64)
    assert alike(a, a) and not alike(a, np.concatenate([a[50:], a[:50]]))  # the same words in another order
    b = a.copy()
    b[::10] = np.arange(1000, 1010, dtype=np.uint64)
    assert alike(a, b)  # 90 of 110
    b[1::10] = np.arange(2000, 2010, dtype=np.uint64)
    assert not alike(a, b)
    assert not alike(a[:0], a[:0])
    wide = np.arange(60_000, dtype=np.uint64) % 977  # long texts whose words repeat
    assert alike(wide, wide[3000:]) and not alike(wide, wide[::-1])


def test_recall_by_edited_share(spark):
    """Texts of 60 to 900 words and one copy each, with a share of the words replaced, deleted or inserted."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    for share in (0.01, 0.03, 0.05, 0.1):
        rows = []
        for k in range(60):
            base = rng.choices(vocabulary, k=rng.choice([60, 200, 900]))
            copy = list(base)
            for at in sorted(rng.sample(range(len(base)), max(1, int(share * len(base)))), reverse=True):
                kind = rng.randrange(4)
                copy[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice(vocabulary)]
            rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        of = {r.doc_id: r.class_id for r in run(spark, frame(spark, rows))}
        assert sum(of[2 * k] == of[2 * k + 1] for k in range(60)) >= 54, share
        assert all(c in (d, d - d % 2) for d, c in of.items())


def test_classes_dont_depend_on_partitions(spark, monkeypatch):
    rows = list(enumerate(without_original(60) + shared_passage(30)))
    one = grouped(run(spark, frame(spark, rows).coalesce(1)))
    monkeypatch.setattr(nd, "MANY_PAIRS", 5)
    assert grouped(run(spark, frame(spark, rows).repartition(5).checkpoint())) == one


def test_equal_sketches_need_equal_order():
    text = " ".join(f"a{i}" for i in range(30))
    words, first = nd.word_hashes(pa.array([text, text.upper(), " ".join(reversed(text.split()))]))
    s = nd.sketches(*nd.kmers(words, first))
    assert (s[0] == s[1]).all() and not (s[0] == s[2]).any()


def test_connect_joins_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 20) if i != 9], "a long, b long")
    labels = spark.range(25).select(F.col("id").alias("row"), F.struct(F.lit(False).alias("none"), F.col("id").alias("doc_id"), F.col("id").alias("row")).alias("label"))
    got = {r.row: r.label.doc_id for r in nd.connect(links, labels, scratch.folder(spark, "links")).collect()}
    assert got == {i: 0 if i <= 9 else 10 for i in range(21)}
