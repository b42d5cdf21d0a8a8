"""URL rules by host and path, as joins of hashed expressions.

Every URL is expanded into its host suffixes (whole labels) and path prefixes; rules and expressions meet in an
equi-join on the first four bytes of a SHA-256 digest, the full digest confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import inner_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains; none for an empty host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return F.filter(suffixes, lambda s: s != "")


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int = 16
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` holds (host, path, verdict). A rule fits its host and every subdomain where the path starts with the
    rule's path. The longest rule (host plus path) wins; of equally long ones the longer host, then ``block``. Without
    a rule, ``rule`` is null and the verdict is ``default``. Null or ``://``-less URLs have empty host and path and fit
    no rule. Rules with a null or empty host fit nothing; a null path counts as empty. Repeated pages get the same
    answer each; columns of ``pages`` named host, path, rule or verdict are replaced, all others are kept.

    Work is done once per different (host, path), and those meet the rules salted: neither a host with a third of all
    pages nor a rule that fits most of them lands in one task.
    """
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    places = pages.select("host", "path").where("host != ''").distinct()
    clean = rules.where("host is not null and host != ''").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    )
    # the lengths that rule paths have: one number for each length, not for each rule
    lengths = sorted(r[0] for r in clean.select(F.length("rule_path")).distinct().collect())
    if not lengths:
        lengths = [0]
    marked = clean.withColumn("digest", F.sha2(F.concat_ws("", "rule_host", F.lit("\n"), "rule_path"), 256))
    marked = marked.withColumn("prefix", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
    marked = marked.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    wanted = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    expressions = (
        places.withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
        .withColumn("n", F.explode(wanted))
        .withColumn("start", F.expr("substring(path, 1, n)"))
        .withColumn("digest", F.sha2(F.concat_ws("", "suffix", F.lit("\n"), "start"), 256))
        .withColumn("prefix", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
        .withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int"))
        .select("host", "path", "digest", "prefix", "salt")
    )
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").cast("int").alias("block"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    found = (
        expressions.join(marked, ["prefix", "salt"])
        .where(expressions["digest"] == marked["digest"])
        .groupBy("host", "path")
        .agg(F.max(order).alias("best"))
    )
    best, a, b = inner_names(pages, "best", "a", "b")
    found = found.select(F.col("host").alias(a), F.col("path").alias(b), F.col("best").alias(best))
    out = pages.join(found, (F.col("host") == F.col(a)) & (F.col("path") == F.col(b)), "left")
    return out.withColumns(
        {"rule": F.col(f"{best}.rule"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default))}
    ).drop(best, a, b)


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) given as a list, as a table."""
    rows = F.explode(
        F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    )
    return spark.range(1).select(rows.alias("r")).select("r.*")
