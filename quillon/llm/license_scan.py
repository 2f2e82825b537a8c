"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a stretch of 2 * STRIDE words that starts at a multiple of STRIDE; every passage of up to STRIDE
words lies whole in one. Tokens are ordered by how many documents hold them, rarest first. A block with
containment |block and template| / |template| >= threshold has at least `need` of the template's tokens, so
it holds one of the template's first size - need + 1 (prefix filter), has at least `need` template tokens
itself (length filter), and what follows the shared token on either side must suffice (positional filter).
Candidates are then counted whole, and the template's name has to stand in the block word for word: containment
of word sets alone can't tell sibling licenses apart. Everything is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, template, and the name that tells it from its siblings. The name's words have to stand
#: consecutively in a block, so a text of one license is never taken for another that differs in a word.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2.0", "licensed under the apache license 2 0", "apache license 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "cc by nc nd 4"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
)
THRESHOLD = 0.85
STRIDE = 32
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    """A-Z in lower case. The two other characters whose lower case holds an ASCII letter are set aside first."""
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("")), F.lit("İ"), F.lit("")))


def spaced_words(text: Column) -> Column:
    """The words of a text in lower case, each between single spaces, with a space at either end."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(_lowered(text), SEPARATORS, " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _need(template: str, threshold: float) -> int:
    return math.ceil(threshold * len(set(template.split())) - 1e-9)


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary (bounded by the templates) by the number of documents with each token, over all rows."""
    words = F.split("s", " ")
    held = docs.select(spaced_words(F.col("text")).alias("s")).select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("w"))
    counts = {r.w: r["count"] for r in held.groupBy("w").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document.

    Null and empty texts have no words, places or labels (score 0). score is 1 with a base phrase, else the
    best containment of a label's template. A very long text is cut into blocks like any other. Repeated rows
    come out repeated; an empty table gives no rows; other columns are not read, whatever their names.
    """
    if max(len(t.split()) for _, t, _ in templates) > STRIDE:
        raise ValueError(f"a template is longer than {STRIDE} words")
    rows = id_and_text(docs, id_col, text_col)
    order = token_order(rows, sorted({w for _, t, _ in templates for w in t.split()}))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, text, name in templates:
        tokens, need = sorted(set(text.split()), key=rank.__getitem__), _need(text, threshold)
        index += [(w, label, f" {name} ", i, len(tokens), need, tokens) for i, w in enumerate(tokens[: len(tokens) - need + 1])]
    prefix = F.array(*map(F.lit, sorted({x[0] for x in index})))
    vocabulary = F.array(*map(F.lit, order))
    spark = docs.sparkSession
    templates_df = spark.createDataFrame(index, "token string, label string, name string, place int, size int, need int, tokens array<string>")

    s = rows.select("doc_id", spaced_words(F.col("text")).alias("s")).select("doc_id", "s", F.monotonically_increasing_id().alias("row"))
    s = s.withColumn("n_words", F.when(F.col("s") == "  ", 0).otherwise(_spaces(F.col("s")) - 1).cast("long"))
    for i, (phrase, _) in enumerate(PHRASES):
        s = s.withColumn(f"cut{i}", F.when(F.contains("s", F.lit(f" {phrase} ")), F.split("s", f" {phrase}(?= )", -1)))
    first = [_spaces(F.element_at(f"cut{i}", 1)) for i in range(len(PHRASES))]
    last = [F.col("n_words") - (_spaces(F.element_at(f"cut{i}", -1)) - 1) - len(p.split()) for i, (p, _) in enumerate(PHRASES)]
    base = s.select(
        "row", "doc_id", "s", "n_words",
        sum((F.coalesce(F.size(f"cut{i}") - 1, F.lit(0)) for i in range(len(PHRASES))), F.lit(0)).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.filter(F.array(*[F.when(F.col(f"cut{i}").isNotNull(), label) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull()).alias("base"),
        F.split(F.btrim("s"), " ").alias("words"),
    )
    of_block = lambda i: F.slice("words", i * STRIDE + 1, 2 * STRIDE)
    starts = F.filter(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / STRIDE).cast("int")), lambda i: F.arrays_overlap(of_block(i), prefix))
    blocks = F.when(F.arrays_overlap("words", prefix), F.transform(starts, lambda i: F.struct(F.array_intersect(vocabulary, of_block(i)).alias("tokens"), F.concat(F.lit(" "), F.array_join(of_block(i), " "), F.lit(" ")).alias("text"))))
    base = base.withColumn("blocks", blocks).drop("s", "words")
    block = base.withColumn("at", F.explode_outer("blocks")).withColumn("block", F.col("at.tokens")).withColumn("text", F.col("at.text")).drop("blocks", "at")
    token = block.withColumn("token", F.explode_outer(F.array_intersect("block", prefix)))
    at = F.array_position("block", F.col("token"))  # from 1
    fits = (F.size("block") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("place") - 1, F.size("block") - at) >= F.col("need"))
    joined = token.join(F.broadcast(templates_df).withColumnRenamed("token", "shared"), (F.col("token") == F.col("shared")) & fits, "left")
    share = F.size(F.array_intersect("block", "tokens"))
    is_hit = (share >= F.col("need")) & F.contains("text", F.col("name"))
    hit = F.when(is_hit, F.col("label"))
    keep = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    out = joined.select("row", *keep, hit.alias("hit"), F.when(is_hit, share / F.col("size").cast("double")).alias("share")).groupBy("row", *keep).agg(F.collect_set("hit").alias("more"), F.max("share").alias("share"))
    told = lambda x: F.array_join(F.array_sort(x), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", told(F.col("base")).alias("base_labels"),
        told(F.array_distinct(F.concat("base", "more"))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def scan_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB, by counting every template in every block that has its name."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    starts = " || ".join(f"list_filter(range(1, n + 1), lambda i: {' AND '.join(f'''w[i + {j}] = '{x}' ''' for j, x in enumerate(p.split()))})" for p, _ in PHRASES)
    has = " || ".join(f"CASE WHEN contains(s, ' {p} ') THEN ['{label}'] ELSE [] END" for p, label in PHRASES)
    lists = [(label, sorted(set(t.split())), _need(t, threshold), name) for label, t, name in templates]
    share = lambda words, name: f"coalesce(list_max(list_transform(list_filter(blocks, lambda b: contains(' ' || array_to_string(b, ' ') || ' ', ' {name} ')), lambda b: len(list_intersect(list_distinct(b), {words})))), 0)"
    cols = ", ".join(f"{share(words, name)} AS t{i}" for i, (_, words, _, name) in enumerate(lists))
    more = " || ".join(f"CASE WHEN t{i} >= {need} THEN ['{label}'] ELSE [] END" for i, (label, _, need, _) in enumerate(lists))
    best = ", ".join(f"CASE WHEN t{i} >= {need} THEN t{i} / CAST({len(words)} AS DOUBLE) ELSE 0 END" for i, (_, words, need, _) in enumerate(lists))
    return f"""
    WITH a AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') AS t FROM documents),
    b AS (SELECT doc_id, ' ' || t || ' ' AS s, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM a),
    c AS (SELECT *, CAST(len(w) AS BIGINT) AS n FROM b),
    d AS (SELECT doc_id, n, {starts} AS places, {has} AS base, list_transform(range(0, n, {STRIDE}), lambda i: w[i + 1 : i + {2 * STRIDE}]) AS blocks FROM c),
    e AS (SELECT *, {cols} FROM d)
    SELECT doc_id, n AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
           array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || {more})), ',') AS labels,
           CASE WHEN len(places) > 0 THEN 1.0 ELSE CAST(greatest({best}) AS DOUBLE) END AS score
    FROM e"""
