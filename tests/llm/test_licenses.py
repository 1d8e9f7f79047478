import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veilframe.llm import licenses as x

GPL = "This work is licensed under the GNU General Public License, version 3."
MIT = "Released under the MIT License."
APACHE = "Licensed under the Apache License, Version 2.0."


def files(spark, rows):
    schema = StructType([StructField("doc_id", LongType()), StructField("path", StringType()), StructField("text", StringType()), StructField("license", StringType()), StructField("dir", StringType())])
    return spark.createDataFrame([(*r, "x", "y") for r in rows], schema)


ROWS = [
    (1, "LICENSE", MIT),
    (2, "a/b/LICENSE.txt", f"Some header\n{GPL}\nmore words"),
    (3, "a/b/c/d/file.txt", "nothing here"),
    (4, "a/x.txt", "plain text"),
    (5, "a/b/y.txt", f"intro words\n\n{APACHE}\nbody body body"),
    (6, None, "plain"),
    (7, "z.txt", None),
    (8, "a/b/c/LICENSE", "no licence text in it"),
    (9, "", ""),
    (10, "a/b/c/e.txt", "we spoke of licensing laws and of permission slips at length in the meeting of the board"),
    (10, "a/b/c/e.txt", "we spoke of licensing laws and of permission slips at length in the meeting of the board"),
    (11, "q/long.txt", "word " * 50_000 + "\n" + MIT),
]


def scan(spark, rows):
    out = x.scan_licenses(files(spark, rows)).select(F.col("doc.c0").alias("id"), "license", "effective", "from_dir").collect()
    return sorted([tuple(r) for r in out], key=repr)


def test_own_and_inherited(spark):
    want = [
        (1, "MIT", "MIT", None),
        (2, "GPL-3.0", "GPL-3.0", None),
        (3, None, "GPL-3.0", "a/b"),
        (4, None, "MIT", ""),
        (5, "Apache-2.0", "Apache-2.0", None),
        (6, None, None, None),
        (7, None, "MIT", ""),
        (8, None, "GPL-3.0", "a/b"),
        (9, None, "MIT", ""),
        (10, None, "GPL-3.0", "a/b"),
        (10, None, "GPL-3.0", "a/b"),
        (11, "MIT", "MIT", None),
    ]
    assert scan(spark, ROWS) == sorted(want, key=repr)


def test_empty_table(spark):
    assert scan(spark, []) == []


def test_frequencies_count_files(spark):
    n, df = x.word_frequencies(files(spark, ROWS))
    assert n == len(ROWS) and df["mit"] == 2 and df["apache"] == 1 and df["isc"] if "isc" in df else True


def test_cosine_prefers_the_right_template():
    weights = x.Weights(1000, {"the": 900, "license": 30})
    for name, text in x.TEMPLATES:
        assert weights.best([text.encode()]) == (name, weights.best([text.encode()])[1]) and weights.best([text.encode()])[1] > 0.99
    assert weights.best([b"a sentence without any bearing on the matter"])[1] < 0.3


def slow_scores(texts, threshold):
    """Best template and cosine of every text's lines and paragraphs, over plain dictionaries."""
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t))
    frequency = Counter(w for t in texts for w in set(split(t or "")))
    named = {w for _, t in x.TEMPLATES for w in split(t)}
    weight = lambda w: math.log((1 + len(texts)) / (1 + (frequency[w] if w in named else 0))) + 1

    def vector(t):
        return {w: n * weight(w) for w, n in Counter(split(t)).items()}

    def cosine(a, b):
        dot = sum(v * b.get(w, 0.0) for w, v in a.items())
        return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    out = []
    for t in texts:
        best = (0.0, None)
        for part in [*(t or "").split("\n"), *re.split(r"\n[ \t\n\r\x0b\x0c]*\n", t or "")]:
            v = vector(part)
            for name, template in x.TEMPLATES if v else ():
                c = cosine(vector(template), v)
                if c > best[0] + 1e-9 or (best[1] is not None and c > best[0] - 1e-9 and name < best[1]):
                    best = (c, name)
        out.append((best[1], round(best[0], 9)) if best[0] >= threshold else (None, 0.0))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_bounds_lose_nothing(spark, threshold):
    rng = random.Random(int(threshold * 10))
    plain = "the of and software for use work under a version public domain license terms garden river table 4 0".split()
    texts = [None, "", "\n\n", " \n\t\n", "\nThis is free and unencumbered software released into the public\n domain.\n",
             "Licen\u0160e Licensed under CC BY-SA 4.0.\r\n\r\nx", "Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0."]
    for _ in range(150):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(x.TEMPLATES)[1].split()
            cut = sorted(rng.sample(range(len(words) + 1), 2))
            some = words[cut[0] : cut[1]] + rng.choices(plain, k=rng.randrange(8))
            if rng.random() < 0.3:
                rng.shuffle(some)
            text = " ".join(some)
            if rng.random() < 0.5:
                text = text.replace(" ", "\n", rng.randrange(4))
            lines.append(text.upper() if rng.random() < 0.1 else text)
        texts.append(rng.choice(["\n", "\n\n", "\n \n"]).join(lines))
    rows = files(spark, [(i, f"d/f{i}.txt", t) for i, t in enumerate(texts)])
    got = {r.id: (r.license, round(r.score, 9)) for r in x.scan_licenses(rows, threshold=threshold).select(F.col("doc.c0").alias("id"), "license", "score").collect()}
    want = slow_scores(texts, threshold)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(name is not None for name, _ in want) > 10


def test_a_wrapped_notice_is_found(spark):
    rows = [(1, "a.txt", "code\n\nThis is free and unencumbered software released into the public\ndomain.\n\ncode"), *ROWS[1:]]
    assert (1, "Unlicense", "Unlicense", None) in scan(spark, rows)


def test_ties_go_to_the_first_template_by_name(spark):
    weights = x.Weights(10, {})
    two = [t.encode() for name, t in x.TEMPLATES if name in ("MPL-2.0", "ISC")]
    assert weights.best(two)[0] == weights.best(two[::-1])[0] == "ISC"
