"""Review queues: disagreements grouped by type, with counts, examples and strata, and their safe adjudication."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.operators.policy import clean_value
from lauda.operators.topk import top_per_group
from lauda.plans.contract import read_document
from lauda.session import maybe_broadcast

SETTLED = ("accepted_cross_verified", "abstained_by_consensus")
# Variables with two opposite values, and taxonomies whose values are no synonyms.
BINARY = ("polipo_presente", "hernia_hiatal_estrita", "hernia_hiatal", "barrett_presente", "ulcera_presente", "ee_presente",
    "sangramento_ativo", "ceco_atingido")
NUMERIC_TAXONOMIES = ("NUM-C", "MEAS-N", "ORD-E", "NUM-I")
MIN_COUNT, SKEW = 10, 0.70


def disagreements(evidence: DataFrame) -> DataFrame:
    """Cells whose two readers differ as text, but for those a verifier has settled."""
    e = evidence.select("evidence_id", "variable", "clinica", clean_value(F.col("value")).alias("l1"),
        clean_value(F.col("ia")).alias("l2"), "resolution")
    return e.where(F.col("l1").isNotNull() & F.col("l2").isNotNull() & (F.col("l1") != F.col("l2")) & ~F.coalesce(F.col("resolution"),
            F.lit("")).isin(*SETTLED))


def pair_items(evidence: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent disagreement pairs of every variable, ties by the pair."""
    pairs = disagreements(evidence).groupBy("variable", "l1", "l2").agg(F.count("*").alias("n"))
    return top_per_group(pairs, ["variable"], [F.desc("n"), F.col("l1"), F.col("l2")], top, "l1")


def with_examples(cells: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Up to k example rows (the least ids) per group, as a joined list."""
    ex = top_per_group(cells, keys, [F.col("evidence_id")], k, "evidence_id")
    return ex.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("evidence_id")),
                lambda x: x.cast("string")),
            ",").alias("examples"))


def stratum_shares(cells: DataFrame, keys: list[str], strata: list[str]) -> DataFrame:
    """(keys, stratum, bucket, n, share): histogram of each stratum column, missing as its own bucket."""
    long = cells.select(*keys,
        F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"),
                F.coalesce(F.col(s).cast("string"), F.lit("__missing__")).alias("bucket")) for s in strata])).alias("s"))
    counts = long.groupBy(*keys, "s.stratum", "s.bucket").agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys, "stratum").agg(F.sum("n").alias("total"))
    return counts.join(total, [*keys, "stratum"]).select(*keys, "stratum", "bucket", "n",
        F.round(F.col("n") / F.col("total"), 6).alias("share"))


def pairs_with_share(cells: DataFrame, stratum: str) -> DataFrame:
    """(variable, l1, l2, n, share): disagreement pairs with the share of their leading bucket, in one aggregation tree."""
    per = cells.groupBy("variable", "l1", "l2",
        F.coalesce(F.col(stratum).cast("string"), F.lit("__missing__")).alias("bucket")).agg(F.count("*").alias("m"))
    return per.groupBy("variable", "l1", "l2").agg(F.sum("m").alias("n"), F.round(F.max("m") / F.sum("m"), 6).alias("share"))


def adjudicate(items: DataFrame, members: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Which pairs may become aliases: guards in order, the first that holds sends the pair to review.

    items: (variable, l1, l2, n, share of the leading stratum bucket); members: (variable, vals);
    taxonomy: (variable, tags).
    """
    c = F.col
    x = items.join(maybe_broadcast(members), "variable", "left").join(maybe_broadcast(taxonomy), "variable", "left")
    vals = F.coalesce("vals", F.array().cast("array<string>"))
    reason = (
        F.when(c("n") < MIN_COUNT,
            "count_below_threshold").when(F.array_contains(vals, c("l1")) & F.array_contains(vals, c("l2")),
            "canonical_value_inversion")
        .when(c("variable").isin(*BINARY),
            "canonical_binary_inversion").when(F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")),
                F.array(*map(F.lit, NUMERIC_TAXONOMIES))),
            "numeric_variable")
        .when(c("share") >= SKEW, "skew")
    )
    return x.select("variable", "l1", "l2", "n", F.when(reason.isNull(), "apply").otherwise("escalate").alias("decision"),
        reason.alias("reason"))


def new_aliases(decisions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases that applied decisions add to the registry: (variable, alias, canonical), known ones left out."""
    add = decisions.where("decision = 'apply'").groupBy("variable",
        F.col("l2").alias("alias")).agg(F.max_by("l1", F.struct("n", "l1")).alias("canonical"))
    return add.join(aliases.select("variable", "alias").distinct(), ["variable", "alias"], "left_anti")


# Gate files: items of both gates in one form, written as JSON lines and read back.
ITEM = "item_id string, gate int, variable string, kind string, key string, n long, action string, blocking boolean, examples array<string>"
SOURCE, REVIEW = "add_policy_or_lower_criticality", "add_vocabulary_alias_or_reject"


def quoted(c: Column) -> Column:
    """A value in single quotes, or in double ones where it holds a single quote and no double one."""
    q = F.when(c.contains("'") & ~c.contains('"'), F.lit('"')).otherwise(F.lit("'"))
    body = F.when(q == "'", F.replace(c, F.lit("'"), F.lit("\\'"))).otherwise(c)
    return F.when(c.isNull(), "None").otherwise(F.concat(q, body, q))


def pair_key(l1: Column, l2: Column) -> Column:
    """Both readings of a disagreement as one text."""
    return F.concat(F.lit("L1="), quoted(l1), F.lit(" vs IA="), quoted(l2))


def parse_pair(key: Column) -> Column:
    """(l1, l2) of a pair key; NULLs for a text of another form."""
    side = r"(None|'(?:[^'\\]|\\.)*'|\"[^\"]*\")"
    whole = rf"(?s)^L1={side} vs IA={side}$"

    def value(i):
        x = F.regexp_extract(key, whole, i)
        inner = F.substring(x, F.lit(2), F.length(x) - 2)
        return F.when((x == "") | (x == "None"),
            F.lit(None).cast("string")).otherwise(F.when(x.startswith("'"),
                F.replace(inner, F.lit("\\'"), F.lit("'"))).otherwise(inner))

    return F.struct(value(1).alias("l1"), value(2).alias("l2"))


def _item(df: DataFrame, gate: int, kind: Column, key: Column, n: Column, action: Column, blocking: Column,
    examples: Column) -> DataFrame:
    x = df.select(F.lit(gate).alias("gate"), "variable", kind.alias("kind"), key.alias("key"), n.cast("long").alias("n"),
        action.alias("action"), blocking.alias("blocking"), examples.alias("examples"))
    return x.select(F.substring(F.sha2(F.concat_ws("|", F.col("gate").cast("string"), "variable", "kind", "key"), 256), 1,
            12).alias("item_id"),
        *x.columns)


def gate1_items(checks: DataFrame) -> DataFrame:
    """Items of the first gate from the check of a contract (variable, severity, message): errors block."""
    none = F.array().cast("array<string>")
    return _item(checks, 1, F.col("severity"), F.col("message"), F.lit(1), F.lit(SOURCE), F.col("severity") == "error", none)


def gate2_items(evidence: DataFrame, top: int = 10) -> DataFrame:
    """Items of the second gate: escalated cells by status, and the leading disagreement pairs, with examples."""
    e = evidence.where("resolution = 'escalated_case'").select("evidence_id", "variable",
        F.coalesce("status", F.lit("None")).alias("status"))
    n = e.groupBy("variable", "status").agg(F.count("*").alias("n")).join(with_examples(e, ["variable", "status"]),
        ["variable", "status"])
    ex = F.split(F.coalesce("examples", F.lit("")), ",")
    a = _item(n, 2, F.lit("escalated"), F.col("status"), F.col("n"), F.lit("review_status"), F.lit(False), ex)
    keys = ["variable", "l1", "l2"]
    pairs = pair_items(evidence, top)
    found = with_examples(disagreements(evidence).join(maybe_broadcast(pairs.select(*keys)), keys, "left_semi"), keys)
    b = _item(pairs.join(found, keys), 2, F.lit("disagreement"), pair_key(F.col("l1"), F.col("l2")), F.col("n"),
        F.lit(REVIEW), F.lit(False), ex)
    return a.unionByName(b)


def write_gates(items: DataFrame, folder: str) -> dict:
    """Items as JSON lines below folder/gate=N; counts per gate and of blocking items."""
    items.write.mode("overwrite").partitionBy("gate").json(folder)
    back = read_gates(items.sparkSession, folder).groupBy("gate").agg(F.count("*").alias("n"),
        F.count_if("blocking").alias("blocking")).collect()  # one row a gate
    return {"gate1": 0, "gate2": 0} | {f"gate{r['gate']}": r["n"] for r in back} | {"blocking": sum(r["blocking"] for r in back)}


def read_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Gate items of a folder; malformed lines are left out."""
    return spark.read.schema(ITEM).option("mode", "DROPMALFORMED").json(folder)


def gate_summary(items: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent items of the second gate, ties by variable, kind and key."""
    return items.where("gate = 2").orderBy(F.desc("n"), "variable", "kind", "key").limit(top).select("variable", "kind",
        "key", "n")


def patch_registry(text: str, aliases: list[tuple[str, str, str]], abstentions: list[tuple[str, str]] = (),
    values: list[tuple[str, str]] = ()) -> tuple[str, int]:
    """(registry text, number of changes) after adding aliases, abstention statuses and ontology values.

    What stands in the registry already is skipped; an unknown variable raises KeyError.
    """
    d, n = read_document(text), 0
    policies = d.get("policies") or {}
    for v, alias, canonical in aliases:
        known = policies[v].setdefault("vocabulary_aliases", {})
        if alias not in map(str, known):
            known[alias], n = canonical, n + 1
    for where, rows in (("abstention_statuses", abstentions), ("values", values)):
        for v, x in rows:
            o = policies[v] if where != "values" else policies[v].get("output_ontology") or policies[v]["ontology"]
            known = o.setdefault(where, [])
            if x not in map(str, known):
                known.append(x)
                n += 1
    return json.dumps(d, ensure_ascii=False, indent=1), n


def rewrite_registry(spark: SparkSession, path: str, aliases, abstentions=(), values=()) -> int:
    """patch_registry on a file of any file system; the old text stays beside it as .bak. No change, no write."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    new, n = patch_registry(old, aliases, abstentions, values)
    if n:
        for target, body in ((p.suffix(".bak"), old), (p.suffix(".tmp"), new)):
            out = fs.create(target, True)
            out.write(bytearray(body.encode()))
            out.close()
        fs.delete(p, False)
        fs.rename(p.suffix(".tmp"), p)
    return n
