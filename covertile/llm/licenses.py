"""Licence scans with a trained paragraph classifier, in DataFrame functions only.

Paragraphs are the lines of a text.  A multinomial logistic regression over word 1- and 2-grams (each
counts once per paragraph) tells licence families, licence-like text of no known family
(``unknown``) and ordinary text (``none``).  It is trained on the driver on the fixed templates below,
with held-out folds for the temperature that calibrates its probabilities; weights become
integers (thousandths of a nat), so sums are exact in any order.  A family must reach
``sure`` of the calibrated probability, otherwise the paragraph is ``unknown`` if ordinary text is less
likely than not; and a family counts only if the paragraph holds at least ``overlap`` of the distinct
words of one of its templates, otherwise it is ``unknown`` as well.

On Spark: lines explode into grams, grams meet the weights in a broadcast join (the weights come from the
templates, some hundreds of rows whatever the corpus), and only grams that have weights are summed per
paragraph.  A paragraph without any is ordinary text.

Defined results: null and empty texts have no licence; repeated paragraphs count each; rows
with a null id get no findings; rows that share an id are judged one by one, and each row of the id gets what was found
in all of them; ties between families go to the first in alphabetical order.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence statements by family.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "this program is free software under the terms of the gnu affero general public license", "spdx-license-identifier agpl-3.0-or-later", "released under the agpl v3"],
    "apache": ["licensed under the apache license version 2.0", "you may obtain a copy of the license at www.apache.org licenses license-2.0", "spdx-license-identifier apache-2.0", "this project is released under the apache 2.0 license", "distributed under the terms of the apache license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3-clause license", "released under the bsd 2-clause license", "spdx-license-identifier bsd-3-clause", "use of this source code is governed by a bsd-style license"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "available under the creative commons attribution license cc by"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 license", "licensed under the creative commons attribution non-commercial license cc by-nc"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 license", "text is available under the creative commons attribution sharealike license cc by-sa"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it under the terms of the gnu general public license", "spdx-license-identifier gpl-3.0-or-later", "released under the gpl version 2", "licensed under the gpl v3"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "this library is free software under the terms of the gnu lesser general public license", "spdx-license-identifier lgpl-2.1-only", "released under the lgpl"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "licensed under the mit license", "spdx-license-identifier mit", "this project is mit licensed"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "spdx-license-identifier mpl-2.0", "released under the mpl 2.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released into the public domain under the unlicense", "spdx-license-identifier unlicense", "dedicated to the public domain under cc0 1.0"],
}
# Licence-like statements of no family above.
UNKNOWN = ["licensed under a proprietary license all rights reserved", "copyright all rights reserved", "this software is provided under a commercial license agreement", "no license is granted", "released under the terms of our license", "licensed under the license", "see the license file for license terms", "spdx-license-identifier licenseref-custom", "redistribution is not permitted without written permission", "licensed to you under the end user license agreement"]
# Ordinary sentences with words that licences share.
NONE = ["the driver showed a license to the officer", "version 3 of the report was released today", "the general opinion of the public was free of doubt", "he asked for permission to use the work", "the project started in the source of the river", "apache helicopters flew over the village", "the university mit is in cambridge", "the terms were good and the copy was made", "software is written by a person", "creative people live in the commons", "the mozilla foundation published a form", "a copy of the book was released", "free of charge", "the international library opened", "this work is under way", "attribution of the painting is not certain", "they may obtain a version at the library", "general public", "source and binary stars", "with or without you"]
# Words that carry no weight on their own.
STOP = set("a an and any are as at be been by can for from has have he in into is it may no not of on or our over that the their them they this to under was we were with without written you your".split())
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
FAMILIES = sorted(TEMPLATES)
CLASSES = [*FAMILIES, "none", "unknown"]


def grams(text: str) -> list[str]:
    """Distinct 1- and 2-grams that are not stop words alone."""
    words = re.findall(TOKEN, text.lower())
    return sorted({w for w in words if w not in STOP} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if not (a in STOP and b in STOP)})


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _train(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated gradient descent; the bias keeps paragraphs without grams ordinary."""
    k, target = len(CLASSES), np.eye(len(CLASSES))[y]
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    b[CLASSES.index("none")] = 4.5
    last, rate = w.copy(), 1.5
    for t in range(rounds):
        ahead = w + t / (t + 3) * (w - last)
        p = _softmax(x @ ahead + b)
        last, w = w, ahead - rate * (x.T @ (p - target) / len(x) * 4 + ridge / 10 * ahead)
    return w, b


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, list[int]], list[int]]:
    """Integer weights per gram and class, and biases, in thousandths, temperature applied."""
    rows = [(t, CLASSES.index(f)) for f in FAMILIES for t in TEMPLATES[f]] + [(t, CLASSES.index("unknown")) for t in UNKNOWN] + [(t, CLASSES.index("none")) for t in NONE]
    vocabulary = sorted({g for t, _ in rows for g in grams(t)})
    place = {g: j for j, g in enumerate(vocabulary)}
    x, y = np.zeros((len(rows), len(vocabulary))), np.array([c for _, c in rows])
    for i, (t, _) in enumerate(rows):
        x[i, [place[g] for g in grams(t)]] = 1
    held = np.zeros((len(rows), len(CLASSES)))
    for f in range(5):
        out = np.arange(len(rows)) % 5 == f
        w, b = _train(x[~out], y[~out])
        held[out] = x[out] @ w + b
    heat = min(np.linspace(0.3, 3, 28), key=lambda h: -np.log(_softmax(held / h)[np.arange(len(rows)), y] + 1e-12).mean())
    w, b = _train(x, y)
    return {g: np.round(w[j] / heat * 1000).astype(int).tolist() for g, j in place.items()}, np.round(b / heat * 1000).astype(int).tolist()


def judged(sums: list[int], sure: float = 0.5) -> str:
    """The class of a paragraph by its summed weights (with biases); the rule of the SQL below, for tests."""
    top = max(sums)
    p = [math.exp((s - top) / 1000) for s in sums]
    best = max(range(len(FAMILIES)), key=lambda c: (sums[c], -c))
    if p[best] / sum(p) >= sure:
        return FAMILIES[best]
    return "none" if p[CLASSES.index("none")] / sum(p) >= 0.5 else "unknown"


def _choice(sure: float) -> str:
    """SQL for the class of a row with columns ``s0 .. sN`` and their maxima ``top`` and (of families) ``best``; families come first, in order."""
    total = "(" + " + ".join(f"exp((s{c} - top) / 1000.0)" for c in range(len(CLASSES))) + ")"
    names = " ".join(f"WHEN s{c} = best THEN '{f}'" for c, f in enumerate(FAMILIES))
    none = CLASSES.index("none")
    return f"CASE WHEN exp((best - top) / 1000.0) / {total} >= {sure} THEN CASE {names} END WHEN exp((s{none} - top) / 1000.0) / {total} >= 0.5 THEN 'none' ELSE 'unknown' END"


def template_words() -> list[tuple[str, list[str]]]:
    return [(f, sorted(set(re.findall(TOKEN, t)))) for f in FAMILIES for t in TEMPLATES[f]]


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", sure: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """``key, line long, family`` of every licence paragraph; family may be ``unknown``."""
    spark = df.sparkSession
    weights, bias = model()
    table = spark.createDataFrame([(g, *w) for g, w in weights.items()], "gram string, " + ", ".join(f"w{c} int" for c in range(len(CLASSES))))
    plain = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # rows that share an id are told apart
    lines = df.select(key, F.monotonically_increasing_id().alias("_row"), F.posexplode(F.split(plain, "\n")).alias("line", "body"))
    # a generator keeps the words of a line as a column; otherwise every use would extract them again
    found = F.expr(f"array(regexp_extract_all(body, '{TOKEN}', 0))")
    words = lines.select(key, "_row", "line", F.explode(found).alias("words")).where(F.size("words") > 0)
    both = F.expr("array_distinct(concat(words, zip_with(slice(words, 1, size(words) - 1), slice(words, 2, size(words)), (a, b) -> concat(a, ' ', b))))")
    hits = words.select(key, "_row", "line", "words", F.explode(both).alias("gram")).join(F.broadcast(table), "gram")
    sums = hits.groupBy(key, "_row", "line").agg(F.first("words").alias("words"), *(F.sum(f"w{c}").cast("long").alias(f"t{c}") for c in range(len(CLASSES))))
    sums = sums.select(key, "line", "words", *((F.col(f"t{c}") + bias[c]).alias(f"s{c}") for c in range(len(CLASSES))))
    # generators again: the two maxima and the class are columns, not expressions copied into every use
    cols = [f"s{c}" for c in range(len(CLASSES))]
    tops = sums.withColumn("m", F.explode(F.array(F.struct(F.greatest(*cols).alias("top"), F.greatest(*cols[: len(FAMILIES)]).alias("best")))))
    guessed = tops.select(key, "line", "words", *cols, "m.top", "m.best").withColumn("guess", F.explode(F.array(F.expr(_choice(sure))))).where("guess <> 'none'")
    confirmed = F.lit(False)
    for family, listed in template_words():
        shared = F.size(F.array_intersect(F.array(*map(F.lit, listed)), F.col("words")))
        confirmed = confirmed | ((F.col("guess") == family) & (shared >= math.ceil(overlap * len(listed))))
    return guessed.select(key, F.col("line").cast("long").alias("line"), F.when(confirmed, F.col("guess")).otherwise("unknown").alias("family"))


def by_document(df: DataFrame, key: str = "doc_id", text: str = "text", sure: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """``key, families, n_licensed, n_unknown, first_line`` for every document; families sorted, joined by commas, or empty."""
    found = scan(df, key, text, sure, overlap).groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != "unknown", F.col("family")))), ",").alias("families"),
        F.count_if(F.col("family") != "unknown").alias("n_licensed"),
        F.count_if(F.col("family") == "unknown").alias("n_unknown"),
        F.min("line").alias("first_line"),
    )
    zero = F.lit(0).cast("long")
    out = df.select(key).join(found, key, "left")
    return out.select(key, F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_licensed", zero).alias("n_licensed"), F.coalesce("n_unknown", zero).alias("n_unknown"), "first_line")


def duckdb_sql(sure: float = 0.5, overlap: float = 0.6) -> str:
    """The same result in DuckDB SQL, with the trained weights as a table of values."""
    weights, bias = model()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(g)}, {', '.join(map(str, w))})" for g, w in weights.items())
    cols = ", ".join(f"w{c}" for c in range(len(CLASSES)))
    sums = ", ".join(f"sum(w{c})::BIGINT + {bias[c]} AS s{c}" for c in range(len(CLASSES)))
    tests = " OR ".join(f"(guess = '{f}' AND len(list_intersect([{', '.join(map(quoted, t))}], words)) >= {math.ceil(overlap * len(t))})" for f, t in template_words())
    return f"""
WITH v(gram, {cols}) AS (VALUES {values}),
l AS (SELECT doc_id, unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS body,
             unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
w AS (SELECT doc_id, line, regexp_extract_all(body, '{TOKEN}') AS words FROM l),
g AS (SELECT doc_id, line, words, unnest(list_distinct(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])))) AS gram FROM w WHERE len(words) > 0),
s AS (SELECT doc_id, line, first(words) AS words, {sums} FROM g JOIN v USING (gram) GROUP BY doc_id, line),
m AS (SELECT *, greatest({', '.join(f's{c}' for c in range(len(CLASSES)))}) AS top, greatest({', '.join(f's{c}' for c in range(len(FAMILIES)))}) AS best FROM s),
c AS (SELECT *, {_choice(sure)} AS guess FROM m),
f AS (SELECT doc_id, line, CASE WHEN {tests} THEN guess ELSE 'unknown' END AS family FROM c WHERE guess <> 'none'),
d AS (SELECT doc_id, coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (family <> 'unknown'), '') AS families,
             count(*) FILTER (family <> 'unknown') AS n_licensed, count(*) FILTER (family = 'unknown') AS n_unknown, min(line) AS first_line FROM f GROUP BY doc_id)
SELECT documents.doc_id, coalesce(families, '') AS families, coalesce(n_licensed, 0) AS n_licensed, coalesce(n_unknown, 0) AS n_unknown, first_line
FROM documents LEFT JOIN d USING (doc_id)
"""
