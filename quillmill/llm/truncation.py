"""Problem 6: text cut off by field limits, by a self-join on prefixes.

Values without a final stop are looked up as strict prefixes of longer values, then their last sentences as strict
prefixes of longer sentences, both by hashes of fixed-length prefixes. What has no longer copy is cut where it visibly
breaks off; else its last words decide: windows of two and three words are hashed over the distinct sentences, and a tail
that other sentences carry on more often than they end there is cut.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .terms import clean_terms

CUT, WHOLE, OPEN = 1, 0, 2
_CLOSE = "\"'”’»)\\]"
_TERMINAL = r"[.!?。！？]"
_DOUBTFUL = r"(\d\.|(^|[^\p{L}])\p{L}\.|\))$"  # '2.|5 m', 'e.g.| a box', 'a stool (grey)| by the wall': a longer copy tells
_SENTENCE_GAP = rf"(?<=[.!?。！？][{_CLOSE}]{{0,1}}) +|\n"
_TORN = r"[\s….,;:�-]+\z"  # what a cut leaves behind the last word
_CJK = r"([⺀-鿿＀-￯])"
#: Rows up to which a list of hashes is broadcast (some 50 bytes each, lists of lengths apart); beyond, it is shuffled.
BROADCAST_ROWS = 200_000


def _plain(text: str) -> str:
    return re.sub(r"[\s,;|\"'\[\]]+", " ", text.lower()).strip()


def judge_end(text: str | None, terms) -> int:
    """CUT or WHOLE where the value itself tells, else OPEN. ``terms``: the record's own target list, in lower case."""
    s = (text or "").strip().rstrip("​﻿")
    if not any(ch.isalnum() for ch in s):
        return WHOLE  # blank or a mere mark: nothing that could break off
    if re.search(r"(\w[\"'”’)]?\s*(…|\.\.\.)|�|[^\W\d_]-|[,;:])$", s):
        return CUT
    if "<|cid_" in s or "<s_a_" in s:
        if s.rfind("<|cid_begin|>") > s.rfind("<|cid_end|>") or re.search(r"<[^>]*$", s):
            return CUT
        if s.count("[") > s.count("]") or s.count("{") > s.count("}"):
            return CUT
        if re.search(r"<\|cid_end\|>[\"'\])}\s]*$", s):
            return WHOLE
    if re.search(r"[.!?。！？][\"'”’»)\]]*$", s):
        return WHOLE
    last = re.split(r"(?<=[.!?。！？])\s+", s)[-1]
    depth: list[str] = []
    for ch in last:  # a delimiter stack; apostrophes are no delimiters
        if ch in "([{":
            depth.append({"(": ")", "[": "]", "{": "}"}[ch])
        elif ch in ")]}" and depth and depth[-1] == ch:
            depth.pop()
    if depth or last.count('"') % 2:
        return CUT
    own = " ".join(dict.fromkeys(t for t in terms)) if terms is not None and len(terms) else ""
    if own:
        head, colon, rest = last.rpartition(": ")
        tail = _plain(rest if colon and len(head.split()) <= 3 else last)
        own = _plain(own)
        if tail == own:
            return WHOLE
        if len(tail) >= 3 and own.startswith(tail):
            return CUT
    if re.search(r"[)\]}>]$", s):
        return WHOLE
    return OPEN


def _judge(text: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([judge_end(a, b) for a, b in zip(text, terms)], dtype="int32")


def _flat(text: Column) -> Column:
    """The text with single blanks, runs with a line break as one line break."""
    lines = F.regexp_replace(text, r"(?U)[\s\u200b\uFEFF]*[\n\r][\s\u200b\uFEFF]*", "\n")
    flat = F.regexp_replace(lines, r"(?U)[[\s\u200b\uFEFF]&&[^\n]]+", " ")
    odd = text.rlike(r"(?U)  |[[\s\u200b\uFEFF]&&[^ ]]")  # most texts need no change
    return F.btrim(F.when(odd, flat).otherwise(text), F.lit(" \n"))


def _sentences(flat: Column) -> Column:
    """Sentences and lines of a flat text, in lower case."""
    return F.split(F.lower(flat), _SENTENCE_GAP)


def _words(sentence: Column) -> Column:
    """Words of a sentence behind three marks of its begin; a CJK character is a word."""
    spaced = F.when(sentence.rlike(_CJK), F.btrim(F.regexp_replace(F.regexp_replace(sentence, _CJK, " $1 "), " +", " "))).otherwise(sentence)
    return F.concat(F.array(F.lit("^"), F.lit("^"), F.lit("^")), F.split(spaced, " "))


def _ended(sentence: Column) -> Column:
    return sentence.rlike(rf"{_TERMINAL}[{_CLOSE}]*\z")


def _context(words: Column, end: Column, n: int) -> Column:
    """Hash of the ``n`` words up to place ``end`` (1-based)."""
    return F.xxhash64(F.lit(n), *[F.get(words, end - (n - k)) for k in range(n)])


def _two_words(words: Column, end: Column) -> Column:
    """Hash of the two words up to ``end``; null where one is a mere mark, or where they are torn from the label before
    them ('Style: paper cut'), as other texts then use them for something else."""
    word = lambda k: F.get(words, end - 1 - k).rlike(r"[\p{L}\p{N}]")
    return F.when(word(0) & word(1) & ~F.get(words, end - 3).endswith(":"), _context(words, end, 2))


def _windows(words: Column, ended: Column) -> Column:
    """Each window of three and of two words of a sentence with the word that follows, once; '$' follows an end without a stop."""
    q = F.when(ended, words).otherwise(F.concat(words, F.array(F.lit("$"))))
    one = lambda i: F.array(*[F.struct(_context(q, i, n).alias("ctx"), F.get(q, i).alias("next")) for n in (3, 2)])
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(3), F.size(q) - 1), one)))


def _longer(following: Column, word: Column) -> Column:
    return following.startswith(word) & (following != word)


def _two_hashes(*cols: Column) -> list[Column]:
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(11), *cols).alias("k2")]


def _sized(df: DataFrame) -> DataFrame:
    """A kept list, to be broadcast while it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def longer_copies(values: DataFrame, asked: DataFrame) -> DataFrame:
    """``k1, k2, rest, n`` of the asked texts that are strict prefixes of others; ``rest``: two characters that follow,
    ``n``: the number of others (sum of ``weight``).

    ``values``: ``flat, weight``; ``asked``: ``flat``. Case does not count. Prefixes of a fixed length (the largest power of two within an
    asked text) are hashed and joined with the lengths asked for below them; then the whole prefixes of these lengths
    are compared by two 64-bit hashes, so a lead shared by many makes no pairs.
    """
    step = F.expr("shiftleft(1, length(bin(n)) - 1)")  # the largest power of two up to n
    lead = lambda at: F.xxhash64(F.lower(F.left(F.col("flat"), at)))
    sized = asked.select("flat", F.length("flat").alias("n")).filter("n > 0").withColumn("step", step)
    heads = _sized(C.kept(sized.select("n", *_two_hashes(F.lower("flat"))).distinct(), "heads"))
    needed = C.kept(sized.groupBy("step", lead(F.col("step")).alias("lead")).agg(F.collect_set("n").alias("sizes")), "leads")
    steps = sorted(r["step"] for r in needed.select("step").distinct().collect())  # powers of two: a few
    if not steps:
        return heads.select("k1", "k2", F.lit("").alias("rest"), F.lit(0).cast("long").alias("n"))
    leads = F.filter(
        F.array(*[F.when(F.length("flat") > k, F.struct(F.lit(k).alias("step"), lead(F.lit(k)).alias("lead"))) for k in steps]),
        lambda x: x.isNotNull(),
    )
    at = values.select("flat", "weight", F.explode(leads).alias("x")).select("flat", "weight", "x.step", "x.lead").join(_sized(needed), ["step", "lead"])
    at = at.select("flat", "weight", F.explode("sizes").alias("n")).filter(F.length("flat") > F.col("n"))
    found = at.select("weight", "n", *_two_hashes(F.lower(F.left(F.col("flat"), F.col("n")))), F.substring(F.col("flat"), F.col("n") + 1, F.lit(2)).alias("rest"))
    return found.join(heads, ["n", "k1", "k2"], "left_semi").groupBy("k1", "k2", "rest").agg(F.sum("weight").alias("n"))


def truncated_values(values: DataFrame, with_sentences: bool = False):
    """``row_id, field, route`` of the values that break off inside a word or sentence.

    ``values``: ``row_id, field, text, terms`` (``terms`` array<string>: the record's target terms in lower case, as a
    list that stops short of them is cut). Null and blank texts are no cases; an empty table gives no rows; repeated
    rows give repeated rows. Whole texts are read. ``route`` tells what decided, the first that did:

    * 'value': the value is a strict prefix of a longer one that goes on in its line. One that ends in a doubtful stop or
      bracket counts, too, where the copy goes on in the sentence;
    * 'sentence': its last sentence, of three words or more, is a strict prefix of a longer one, in more values than others
      that hold it as it is, and stands nowhere as a line of its own with more text behind it;
    * 'visible': without a longer copy, but with a dangling mark, an open bracket or a list that stops short;
    * 'words': the sentences of other values carry its last words on more often than they end there.

    Each distinct value votes once, however often it is delivered, and never for itself. Sentences are counted before
    their windows are made, and windows before their shuffle, only for contexts that some tail needs, so a template in a
    third of all texts stays one row per map task. ``with_sentences`` also returns the distinct sentences (``s``).
    """
    judge = F.pandas_udf(_judge, "int")
    v = C.kept(values.select("row_id", "field", judge("text", "terms").alias("end"), _flat(F.col("text")).alias("flat")), "values").filter("flat != ''")
    doubtful = (F.col("end") == WHOLE) & F.col("flat").rlike(_DOUBTFUL)
    # a value with a dangling mark is looked up without it
    bare = F.when(F.col("end") == CUT, F.regexp_replace("flat", _TORN, "")).otherwise(F.col("flat"))
    asked = v.filter((F.col("end") != WHOLE) | doubtful).select("row_id", "field", "end", bare.alias("flat"))
    longer = longer_copies(v.select("flat", F.lit(1).alias("weight")), asked.select("flat"))
    carried = longer.groupBy("k1", "k2").agg(
        F.bool_or(~F.col("rest").startswith("\n")).alias("in_line"),
        F.bool_or(F.col("rest").rlike(r"^\d")).alias("digit"),
        F.bool_or(F.col("rest").rlike(r"^ ?\p{Ll}")).alias("small"),
    )
    goes_on = F.when(F.col("end") != WHOLE, F.col("in_line")).when(F.col("flat").rlike(r"\d\.$"), F.col("digit")).otherwise(F.col("small"))
    asked = asked.withColumns(dict(zip(("k1", "k2"), _two_hashes(F.lower("flat"))))).join(_sized(C.kept(carried, "carried")), ["k1", "k2"], "left")
    asked = C.kept(
        asked.filter((F.col("end") != WHOLE) | goes_on).select(
            "row_id", "field", "end", F.coalesce(goes_on, F.lit(False)).alias("copied"), F.element_at(_sentences(F.col("flat")), -1).alias("tail")
        ),
        "asked",
    )
    # distinct sentences with the number of distinct values that hold them; mid: somewhere more text follows
    one_each = v.select("flat", *_two_hashes(F.lower("flat"))).dropDuplicates(["k1", "k2"])
    each = one_each.select(F.posexplode(F.reverse(_sentences(F.col("flat")))).alias("at", "s"))
    sentences = C.kept(each.filter("s != ''").groupBy("s").agg(F.count("*").alias("weight"), F.bool_or(F.col("at") > 0).alias("mid")), "sentences")
    tails = asked.filter(~F.col("copied")).groupBy("tail").agg(F.bool_or(F.col("end") == OPEN).alias("open"))
    tails = tails.join(sentences.filter(~_ended(F.col("s"))).select(F.col("s").alias("tail"), "weight", "mid"), "tail", "left")
    tails = tails.select("tail", "open", F.coalesce("mid", F.lit(False)).alias("mid"), (F.coalesce("weight", F.lit(1)) - 1).alias("others"), *_two_hashes("tail"))
    tails = C.kept(tails, "tails")
    enough = F.size(F.split("tail", " ")) >= 3
    found = longer_copies(sentences.select(F.col("s").alias("flat"), "weight"), tails.filter(enough & ~F.col("mid")).select(F.col("tail").alias("flat")))
    found = C.kept(found.groupBy("k1", "k2").agg(F.sum("n").alias("n")), "found")
    longer = F.coalesce(F.col("n") > F.col("others"), F.lit(False))
    tails = C.kept(tails.join(_sized(found), ["k1", "k2"], "left").select("tail", "open", "mid", longer.alias("longer")), "looked")
    by_words = _voted(tails.filter("open AND NOT mid AND NOT longer").select("tail"), sentences)
    verdict = tails.filter("longer").select("tail", F.lit("sentence").alias("told")).unionByName(by_words.select("tail", F.lit("words").alias("told")))
    route = F.when(F.col("copied"), "value").when(F.col("told") == "sentence", "sentence").when(F.col("end") == CUT, "visible").otherwise(F.col("told"))
    out = asked.join(verdict, "tail", "left").select("row_id", "field", route.alias("route")).filter("route IS NOT NULL")
    return (out, sentences) if with_sentences else out


def _voted(tails: DataFrame, sentences: DataFrame) -> DataFrame:
    """The distinct ``tail`` strings that the sentences of other values carry on more often than they end there."""
    w, end = F.col("w"), F.size("w")
    k = tails.withColumn("w", _words(F.col("tail"))).select(
        "tail",
        "w",
        F.element_at("w", -1).alias("word"),
        F.when(end > 6, _context(w, F.lit(6), 3)).alias("start"),
        _context(w, end - 1, 3).alias("a3"),
        _two_words(w, end - 1).alias("a2"),
        _context(w, end, 3).alias("b3"),
        _two_words(w, end).alias("b2"),
    )
    # what a sentence says itself is no evidence on it
    own = {}
    for n in (3, 2):
        at = lambda key, ok: F.size(F.filter("own", lambda x: (x["ctx"] == F.col(key)) & ok(x["next"])))
        own[f"own_on{n}"] = at(f"a{n}", lambda y: _longer(y, F.col("word"))) + at(f"b{n}", lambda y: y != "$")
        own[f"own_stop{n}"] = at(f"b{n}", lambda y: y == "$")
    k = C.kept(k.withColumn("own", _windows(w, F.lit(False))).withColumns(own).drop("own", "w"), "kinds")
    needed = _sized(C.kept(k.select(F.explode(F.array("a3", "a2", "b3", "b2")).alias("ctx")).filter("ctx IS NOT NULL").distinct(), "needed"))
    starts = _sized(C.kept(k.select("start").filter("start IS NOT NULL").distinct(), "starts"))
    parts = sentences.select("weight", _words(F.col("s")).alias("w"), _ended(F.col("s")).alias("done"))
    seen = (
        parts.select("weight", F.explode(_windows(w, F.col("done"))).alias("x"))
        .select("weight", "x.ctx", "x.next")
        .join(needed, "ctx", "left_semi")
        .groupBy("ctx", "next")
        .agg(F.sum("weight").alias("n"))
    )
    seen = C.kept(seen, "seen")
    opened = (
        parts.filter(end >= 6)
        .select("weight", _context(w, F.lit(6), 3).alias("start"), "done")
        .join(starts, "start", "left_semi")
        .groupBy("start")
        .agg(F.sum(F.when(F.col("done"), F.col("weight")).otherwise(0)).alias("n_done"), F.sum(F.when(~F.col("done"), F.col("weight")).otherwise(0)).alias("n_open"))
    )
    got = k.join(opened, "start", "left")
    for n in (3, 2):
        in_word = (
            k.join(seen.withColumnRenamed("ctx", f"a{n}"), f"a{n}")
            .filter(_longer(F.col("next"), F.col("word")))
            .groupBy("tail")
            .agg(F.sum("n").alias(f"in_word{n}"))
        )
        after = seen.groupBy("ctx").agg(
            F.sum(F.when(F.col("next") != "$", F.col("n")).otherwise(0)).alias(f"on{n}"),
            F.sum(F.when(F.col("next") == "$", F.col("n")).otherwise(0)).alias(f"stop{n}"),
        )
        got = got.join(in_word, "tail", "left").join(after.withColumnRenamed("ctx", f"b{n}"), f"b{n}", "left")
    z = lambda c, own: F.coalesce(F.col(c), F.lit(0)) - F.col(own)
    on3, on2 = (F.coalesce(F.col(f"in_word{n}"), F.lit(0)) + z(f"on{n}", f"own_on{n}") for n in (3, 2))
    # the larger share decides at any count; two words are asked where three are not seen elsewhere or split evenly
    stop3, stop2 = z("stop3", "own_stop3"), z("stop2", "own_stop2")
    begun = F.col("start").isNotNull() & (F.coalesce("n_done", F.lit(0)) > F.coalesce("n_open", F.lit(0)) - 1)
    return got.filter(begun | (on3 > stop3) | ((on3 == stop3) & (on2 > stop2))).select("tail")


def ins_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.table(spark, sf_dir, "train_cid2ins")
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("text"))
    return (
        t.select("row_id", clean_terms(F.col("target_tid")).alias("terms"), F.explode(F.array(pair("target_ins"), pair("reasoning"))).alias("x"))
        .select("row_id", "x.field", "x.text", "terms")
        .filter(F.col("text").isNotNull())
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_values(ins_values(spark, sf_dir)).select("row_id", "field")


def p6_truncation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, truncated values, their rate and their number by what decided, per source and field."""
    src = C.table(spark, sf_dir, "train_cid2ins").select("row_id", "source_dataset", "target_ins", "reasoning")
    cut = truncated_values(ins_values(spark, sf_dir)).groupBy("row_id").agg(F.map_from_entries(F.collect_set(F.struct("field", "route"))).alias("cut"))
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("there"), F.element_at("cut", f).alias("route"))
    rows = src.join(cut, "row_id", "left").select("source_dataset", F.explode(F.array(pair("target_ins"), pair("reasoning"))).alias("x")).filter("x.there")
    return rows.groupBy("source_dataset", F.col("x.field").alias("field")).agg(
        F.count("*").alias("n_values"), F.count("x.route").alias("n_truncated"), F.round(F.count("x.route") / F.count("*"), 6).alias("rate"),
        *[F.count_if(F.col("x.route") == r).alias(f"n_{r}") for r in ("value", "sentence", "visible", "words")],
    )


SQL: dict[str, str] = {}
QUERIES = {"p6_found": p6_found, "p6_truncation_report": p6_truncation_report}
