"""Problem 4: frequency of every term, by suffix-sorted n-gram counting.

Every suffix of a record's terms, cut to ``max_n``, is combined map-side with equal ones, routed by its first term,
sorted in reverse lexicographic order, and a stack sums the counts of all prefixes in one pass over the sorted run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


def _stack_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of each prefix of a run of suffixes that is sorted so that equal prefixes are adjacent.

    ``n`` occurrences; ``d[l]`` of them open the (l+1)-gram in their record. The stack holds one entry per term of
    the current suffix; leaving a suffix pops, emits and adds occurrences to the shorter prefix below.
    """
    path: list[str] = []
    occ: list[int] = []
    rec: list[int] = []
    out: list[tuple] = []
    field = None

    def pop_to(depth: int) -> None:
        while len(path) > depth:
            out.append((field, list(path), occ[-1], rec[-1]))
            n = occ.pop()
            path.pop()
            rec.pop()
            if occ:
                occ[-1] += n

    for pdf in batches:
        for f, suffix, new_from, n in zip(pdf["field"], pdf["suffix"], pdf["new_from"], pdf["n"]):
            same = 0
            if f == field:
                while same < len(path) and same < len(suffix) and path[same] == suffix[same]:
                    same += 1
            pop_to(same)
            field = f
            for t in suffix[same:]:
                path.append(t)
                occ.append(0)
                rec.append(0)
            occ[-1] += n
            for k in range(new_from - 1, len(path)):
                rec[k] += n
        if out:
            yield pd.DataFrame(out, columns=["field", "gram", "occurrences", "records"])
            out.clear()
    pop_to(0)
    if out:
        yield pd.DataFrame(out, columns=["field", "gram", "occurrences", "records"])


def ngram_counts(records: DataFrame, field: str, terms: str, max_n: int = 1, salts: int = 16) -> DataFrame:
    """``field, gram (array), occurrences, records`` of every run of up to ``max_n`` terms.

    ``records`` has one row per record with a ``field`` name and an array ``terms`` without nulls. A suffix carries
    ``new_from``, the least length from which its prefixes are new in its record (their first place), so that equal
    suffixes of all records collapse before the shuffle and no record ids travel: a term in a third of all records
    costs one row per map task. Suffixes go to the partition of their first term, salted by the second; the partial
    sums of a prefix are added at the end. Null or empty arrays give nothing, an empty table gives no rows.
    """
    t = F.col(terms)
    places = F.sequence(F.lit(1), F.size(t))
    # for place i: the number of lengths l whose run at i also starts at an earlier place; runs nest, so it is the
    # longest common start with any earlier suffix
    if max_n == 1:
        new_from = lambda i: F.when(F.array_position(t, F.element_at(t, i)) < i, 2).otherwise(1)
    else:

        def new_from(i):
            def seen(length):
                run = F.slice(t, i, length)
                earlier = F.filter(F.sequence(F.lit(1), F.greatest(i - 1, F.lit(1))), lambda j: j < i)
                return (i + length - 1 <= F.size(t)) & F.exists(earlier, lambda j: F.slice(t, j, length) == run)

            return F.size(F.filter(F.sequence(F.lit(1), F.lit(max_n)), seen)) + 1

    suffixes = (
        records.filter(F.size(t) > 0)
        .select(field, F.explode(F.transform(places, lambda i: F.struct(F.slice(t, i, max_n).alias("suffix"), new_from(i).cast("int").alias("new_from")))).alias("_s"))
        .groupBy(F.col(field).alias("field"), F.col("_s.suffix").alias("suffix"), F.col("_s.new_from").alias("new_from"))
        .agg(F.count("*").alias("n"))
    )
    routed = suffixes.repartition(
        "field", F.element_at("suffix", 1), F.pmod(F.xxhash64(F.get("suffix", F.lit(1))), F.lit(salts))
    ).sortWithinPartitions("field", F.desc("suffix"), "new_from")
    counted = routed.mapInPandas(_stack_counts, "field string, gram array<string>, occurrences long, records long")
    return counted.groupBy("field", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def clean_terms(col) -> F.Column:
    """Terms in lower case, blanks trimmed and made one; null and blank elements are dropped, null gives []."""
    one = F.transform(col, lambda x: F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " ")))
    return F.coalesce(F.filter(one, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, col in (("pid2cid2tid", "tid"), ("train_cid2ins", "target_tid")):
        t = C.table(spark, sf_dir, name)
        parts.append(C.one_per_record(t, F.lit(f"{name}.{col}").alias("field"), clean_terms(F.col(col)).alias("terms")))
    return parts[0].unionByName(parts[1]).filter(F.size("terms") > 0)


def term_frequencies(records: DataFrame, rare: int = 2, common_share: float = 0.05) -> DataFrame:
    """``field, term, occurrences, records, mark``: 'rare' in at most ``rare`` records, else 'common' from
    ``common_share`` of the field's records with a term, else null."""
    counts = ngram_counts(records, "field", "terms", max_n=1)
    sizes = records.groupBy("field").agg(F.count("*").alias("n_records"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") >= common_share * F.col("n_records"), "common")
    return counts.join(F.broadcast(sizes), "field").select(  # one row per field name
        "field", F.element_at("gram", 1).alias("term"), "occurrences", "records", mark.alias("mark")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(_records(spark, sf_dir)).filter("mark IS NOT NULL").select("field", "term", "mark")


def p4_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(_records(spark, sf_dir))


def p4_bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one to three neighbouring terms."""
    return ngram_counts(_records(spark, sf_dir), "field", "terms", max_n=3).select(
        "field", F.array_join("gram", " | ").alias("gram"), "occurrences", "records"
    )


_CLEAN = r"list_filter(list_transform({c}, lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x IS NOT NULL AND x <> '')"
_SQL = (
    "WITH r AS (SELECT row_number() OVER () AS rid, field, t FROM ("
    + "SELECT 'pid2cid2tid.tid' AS field, "
    + _CLEAN.format(c="tid")
    + " AS t FROM (SELECT DISTINCT pid, sid, tid, updated_ts FROM pid2cid2tid) UNION ALL SELECT 'train_cid2ins.target_tid', "
    + _CLEAN.format(c="target_tid")
    + " FROM (SELECT DISTINCT uid, hist_sid, target_tid, target_ins, reasoning, source_dataset, ts FROM train_cid2ins))"
    + """ WHERE len(t) > 0),
e AS (SELECT rid, field, unnest(t) AS term FROM r),
n AS (SELECT field, count(*) AS n FROM r GROUP BY field),
f AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT rid) AS records FROM e GROUP BY 1, 2),
g AS (SELECT f.field, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records >= 0.05 * n THEN 'common' END AS mark
  FROM f JOIN n ON n.field = f.field)
"""
)
_GRAMS = """, g3 AS (SELECT DISTINCT rid, field, list_aggregate(t[i:i + k - 1], 'string_agg', ' | ') AS gram, i FROM
  (SELECT rid, field, t, i, unnest([1, 2, 3]) AS k FROM (SELECT rid, field, t, unnest(range(1, len(t) + 1)) AS i FROM r)) WHERE i + k - 1 <= len(t))
SELECT field, gram, count(*) AS occurrences, count(DISTINCT rid) AS records FROM g3 GROUP BY 1, 2"""
SQL = {
    "p4_found": _SQL + "SELECT field, term, mark FROM g WHERE mark IS NOT NULL",
    "p4_term_counts": _SQL + "SELECT field, term, occurrences, records, mark FROM g",
    "p4_bigram_counts": _SQL + _GRAMS,
}
QUERIES = {"p4_found": p4_found, "p4_term_counts": p4_term_counts, "p4_bigram_counts": p4_bigram_counts}
