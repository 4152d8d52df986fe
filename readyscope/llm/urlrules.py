"""Verdicts on URLs by a sort-merge range join with nested rules, in DataFrame functions only.

A rule has a host and a path. It fits a URL whose host is the rule's or a subdomain of it
and whose path starts with the rule's; the longest that fits decides. Hosts are keyed by
their labels from the last to the first, each followed by a comma, so that a host and all
its subdomains are the keys with one prefix: an interval of the sorted keys. A path with
all that start with it is an interval too. Keys are bytes, and an interval ends at its
prefix and the byte FF, which UTF-8 does not have.

Intervals of prefixes are nested or apart. So one sweep over the sorted starts, ends and
URLs keeps a stack of the open rules: its height is the running number of starts less
that of ends, and what lies at some height is the rule that started last at that height.
Both are window functions over the sorted rows. The first sweep goes over the hosts and
gives every URL all rule hosts that are open there, the second over the paths within each
rule host and gives the longest path rule.

The sweeps see every distinct host and path once. They are divided by the last label, or
by the rule host. A group with more than its share of keys is dealt over several salts,
and its rules are repeated for each, so that a host with a third of all URLs is no task
of its own. The verdicts go back to the rows with ``attach``.

Defined results: a null URL and one without ``://`` have an empty host and path; rules
without a host fit nothing; a null path of a rule is empty; of rules that are repeated
with several verdicts the greatest in text order holds (block, not allow); rules of equal
length, which have different hosts, are decided by the longer host; without a rule that
fits, ``rule`` is null and the verdict is the default. Repeated rows stay and are judged
alike. Input columns named like results (host, path, rule, verdict) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readyscope.llm.common import attach, columns_of, stored, unused

ALLOW, BLOCK = "allow", "block"
# The rules of the registered query: host, path, verdict
RULES = [
    ("net", "/", BLOCK), ("example.net", "/en/", ALLOW),
    ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _URL, _END = 0, 1, 2
# Parts for each shuffle partition: a part is then small beside a partition
_PARTS = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path of a URL."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """host, path and verdict of a short list of rules."""
    texts = [", ".join("'{}'".format(x.replace("'", "\\'")) for x in rule) for rule in rules]
    values = ", ".join(f"({text})" for text in texts)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")


def host_key(host: Column) -> Column:
    """Equal hosts and subdomains are the keys that start with a host's key."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.concat(F.array_join(labels, ","), F.lit(",")).cast("binary")


def _last_label(host: Column) -> Column:
    return F.element_at(F.split(host, r"\.", -1), -1)


def _with_salts(points: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points dealt over salts where their group is large, rules repeated over the same.

    Only groups with more than one point in ``parts`` are dealt, fewer than ``parts``
    groups therefore: a bounded broadcast.
    """
    spark = points.sparkSession
    parts = _PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = points.groupBy("group").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    large = counts.where(F.col("n") * parts > total)
    salts = large.select("group", F.ceil(F.col("n") * parts / total).cast("int").alias("salts"))
    salts = F.broadcast(stored(salts, "urls-salts"))
    n = F.coalesce("salts", F.lit(1))
    salted = points.join(salts, "group", "left").withColumn(
        "salt", F.pmod(F.xxhash64("host", "path"), n).cast("int")
    )
    repeated = rules.join(salts, "group", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), n - 1))
    )
    return salted.drop("salts"), repeated.drop("salts")


def open_rules(points: DataFrame, rules: DataFrame, innermost: bool) -> DataFrame:
    """The columns of ``points`` (group, key, host, path, key_rows) and ``rule``: a row per
    rule of (group, key, rule) open at the key, or the innermost only; null where none is."""
    points, rules = _with_salts(points, rules)
    start = rules.select("group", "salt", "key", F.lit(_START).alias("kind"), "rule")
    end = start.withColumns({"key": F.concat("key", F.lit(bytearray(b"\xff"))), "kind": F.lit(_END)})
    found = points.select(
        "group", "salt", "key", F.lit(_URL).alias("kind"), F.struct("host", "path", "key_rows").alias("url")
    )
    events = found.unionByName(start, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    sweep = Window.partitionBy("group", "salt").orderBy("key", "kind").rowsBetween(*up_to_here)
    step = F.when(F.col("kind") == _START, 1).when(F.col("kind") == _END, -1).otherwise(0)
    swept = events.withColumn("height", F.sum(step).over(sweep)).where(F.col("kind") != _END)
    height, one = F.col("height"), F.lit(1).cast("long")
    levels = F.array("height")
    if not innermost:
        levels = F.when((F.col("kind") == _URL) & (height > 1), F.sequence(one, height)).otherwise(levels)
    levelled = swept.withColumn("level", F.explode(levels))
    by_level = Window.partitionBy("group", "salt", "level").orderBy("key", "kind").rowsBetween(*up_to_here)
    last = F.last("rule", ignorenulls=True).over(by_level)
    return levelled.withColumn("rule", last).where(F.col("kind") == _URL).select("group", "key", "url.*", "rule")


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW
) -> DataFrame:
    """All columns, and host, path, rule and verdict of every URL."""
    host, path = host_and_path(F.col(url))
    found = {c: unused(pages, f"_{c}") for c in ("host", "path")}
    rows = pages.withColumns({found["host"]: host, found["path"]: path})
    others = columns_of(pages, "host", "path", "rule", "verdict")
    rows = rows.select(*others, F.col(found["host"]).alias("host"), F.col(found["path"]).alias("path"))

    clean = rules.where("host <> ''").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    keys = rows.groupBy("host", "path").agg(F.count("*").alias("key_rows"))
    keys = stored(keys, "urls-keys")

    hosts = clean.select("host").distinct()
    at_hosts = open_rules(
        keys.select(_last_label(F.col("host")).alias("group"), host_key(F.col("host")).alias("key"), "*"),
        hosts.select(
            _last_label(F.col("host")).alias("group"), host_key(F.col("host")).alias("key"),
            F.col("host").alias("rule"),
        ),
        innermost=False,
    )
    at_hosts = stored(at_hosts, "urls-hosts")
    points = at_hosts.where("rule IS NOT NULL").select(
        F.col("rule").alias("group"), F.col("path").cast("binary").alias("key"), "host", "path", "key_rows"
    )
    facts = F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"), "verdict",
    )
    at_paths = open_rules(
        points,
        clean.select(F.col("host").alias("group"), F.col("path").cast("binary").alias("key"), facts.alias("rule")),
        innermost=True,
    )
    none = F.lit(None).cast(at_paths.schema["rule"].dataType)
    fitting = at_paths.select("host", "path", "key_rows", "rule").unionByName(
        keys.select("host", "path", "key_rows", none.alias("rule"))
    )
    best = fitting.groupBy("host", "path").agg(
        F.max("key_rows").alias("key_rows"), F.max("rule").alias("best")
    )
    best = best.select("host", "path", "key_rows", "best.rule", "best.verdict")
    judged = attach(rows, stored(best, "urls-verdicts"), ["host", "path"])
    verdict = F.coalesce("verdict", F.lit(default)).alias("verdict")
    return judged.select(*others, "host", "path", "rule", verdict)


ORACLE = """
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES
    ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
numbered AS (SELECT row_number() OVER () AS place, page_id,
    coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest
    FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM numbered),
parts AS (SELECT place, page_id,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
fitting AS (SELECT parts.*, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY place
        ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS best
    FROM parts LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fitting WHERE best = 1
"""
