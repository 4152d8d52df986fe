import random
import re

import duckdb
import pytest

from readyscope.llm import registry, urlrules


def plain_parts(url):
    """Host and path by the wording of the contract."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_verdict(url, rules, default="allow"):
    """Every rule against the URL."""
    host, path = plain_parts(url)
    fitting = []
    for rule_host, rule_path, verdict in rules:
        if rule_host and (host == rule_host.lower() or host.endswith("." + rule_host.lower())):
            if path.startswith(rule_path or ""):
                rule = rule_host.lower() + (rule_path or "")
                fitting.append((len(rule), len(rule_host), rule, verdict))
    best = max(fitting, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = urlrules.judge_urls(pages, table).collect()
    assert len(rows) == len(urls)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_nested_rules(spark, seed):
    """Hosts and paths that nest deeply, begin alike and end alike; ties and repeats."""
    rng = random.Random(seed)
    labels, steps = ["a", "b", "ab", "a-b", "é", "c"], ["/", "/a", "/a/", "/ab", "/a/b/", "/é"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5)))

    def path():
        return "".join(rng.choice(steps) for _ in range(rng.randint(0, 3)))

    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(120)]
    rules += [("A.b", None, "block"), ("", "/", "block"), (None, "/a", "block"), ("c", "", "allow"), ("c", "", "block")]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{host()}{path()}{rng.choice(['', '?a=/x', '#/a'])}" for _ in range(600)]
    found = judged(spark, urls, rules)
    wanted = {i: plain_verdict(u, rules) for i, u in enumerate(urls)}
    assert found == wanted
    assert len({w[2] for w in wanted.values()}) > 20


def test_odd_urls(spark):
    urls = [
        None, "", "example.net/en/", "http://", "http:///en/x", "http://Example.NET/en/", "http://example.net",
        "http://example.net.", "http://xexample.net/en/a", "http://a.b.example.net/en/", "http://net/", "net://net/x",
        "http://a://b.net/", "http://example.net/EN/", "http://example.com/de", "http://org/fr/?x#y",
        "http://u@example.com:80/de/", "http://x.org/fr/\nnew", "http://a.net/\U0010ffff", "http://é.org/fr/é",
        "http://example.net/en/" + "x" * 100_000, "http://" + "a." * 500 + "net/",
    ]
    assert judged(spark, urls, urlrules.RULES) == {i: plain_verdict(u, urlrules.RULES) for i, u in enumerate(urls)}


def test_hot_host_is_dealt_out(spark):
    """A host with most of the URLs, in a group that is salted, beside small ones."""
    rng = random.Random(5)
    urls = [f"http://w{rng.randrange(9)}.example.net/{rng.choice(['en', 'de'])}/{i}" for i in range(3000)]
    urls += [f"http://x{i}.org/fr/{i % 3}" for i in range(300)] + ["http://same.net/en/"] * 900 + [None] * 900
    assert judged(spark, urls, urlrules.RULES) == {i: plain_verdict(u, urlrules.RULES) for i, u in enumerate(urls)}


def test_query_equals_its_sql(spark, sf_dir):
    found = registry.queries()["op11_url_rules"](spark, sf_dir)
    pages = f"(SELECT * FROM read_parquet('{sf_dir}/pages.parquet'))"
    wanted = duckdb.sql(urlrules.ORACLE.replace("FROM pages", f"FROM {pages}")).fetchall()
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_no_python_in_the_plan(spark, sf_dir):
    found = registry.queries()["op11_url_rules"](spark, sf_dir)
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|CartesianProduct|NestedLoop", plan)


def test_empty_tables_and_clashing_columns(spark):
    rules = urlrules.rule_table(spark)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.judge_urls(empty, rules).count() == 0
    pages = spark.createDataFrame(
        [(1, "http://a.net/", "x", 2, 3, 4)] * 2,
        "page_id long, url string, `Host` string, key_rows int, salt int, `group` int",
    )
    found = urlrules.judge_urls(pages, rules)
    assert found.columns == ["page_id", "url", "key_rows", "salt", "group", "host", "path", "rule", "verdict"]
    row = (1, "http://a.net/", 2, 3, 4, "a.net", "/", "net/", "block")
    assert [tuple(r) for r in found.collect()] == [row] * 2
    none = rules.where("false")
    assert {r["verdict"] for r in urlrules.judge_urls(pages, none, default="block").collect()} == {"block"}
