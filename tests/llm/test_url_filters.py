import re

from pyspark.sql import functions as F

from corpusgraph.llm import url_filters as U

URLS = [None, "", "no scheme", "http://", "HTTP://Spam-Farm.Example.ORG/fr/x?a#b", "http://a.example.net/en/1", "http://example.net", "https://b.example.net/de/", "ftp://x.notexample.com/de/",
        "http://x.example.com/de/1?q", "http://shop.org/fr", "http://shop.org/fr/", "x://y://z.net/", "http://casino.com", "http://uncasino.com/", "http://a.b.net?x", "http://ÄB.net/\n/", "http://net/", "http://a\nb.org/fr/1"]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict or ("block" if set(re.split("[.-]", host)) & set(U.LISTED_LABELS) else "allow")


def test_verdicts_match_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[4], None), (4, URLS[4], None)], "page_id long, url string, host string")
    got = sorted((str(r[0]), *map(str, r[1:])) for r in U.filter_urls(df, U.label_list(df)).collect())
    assert got == sorted((str(r.page_id), *map(str, brute(r.url))) for r in df.collect())
    assert U.filter_urls(df.limit(0), U.label_list(df)).count() == 0


def test_cascade_is_exact_whatever_its_size(spark, monkeypatch):
    rows = [(f"key{i}", i % 7 == 0, "clash") for i in range(3000)] + [("ключ", True, None), ("", False, None)]
    df = spark.createDataFrame(rows, "key string, listed boolean, _part string")
    small = U.BloomCascade(df, bits_per_key=3, hashes=2)
    assert small.n_levels >= 3
    for cascade in (small, U.BloomCascade(df), U.BloomCascade(df, keys_per_part=100)):
        for sent in (U.SENT_BYTES, 0):
            monkeypatch.setattr(U, "SENT_BYTES", sent)
            got = cascade.mark(df, "key", "m")
            assert got.columns == [*df.columns, "m"] and got.count() == len(rows) and got.where("m <> listed").count() == 0
    monkeypatch.setattr(U, "SENT_BYTES", 0)
    assert U.BloomCascade(df, keys_per_part=300).mark(df, "key", "m").where("m <> listed").count() == 0
    none = U.BloomCascade(df.where("not listed"))
    assert none.mark(df, "key", "m").where("m").count() == 0


def test_a_list_of_hosts_and_domains(spark):
    hosts = ["a.bad.com", "bad.com", "notbad.com", "x.y.worse.org", "worse.org.uk", "", "Bad.COM", None]
    df = spark.createDataFrame([(i, None if h is None else f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    listed = spark.createDataFrame([("BAD.com",), ("worse.org",), ("worse.org",), (None,)], "host string")
    got = {r.page_id: r.verdict for r in U.filter_urls(df, listed).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow"}
    assert U.filter_urls(df, listed.limit(0)).where("verdict = 'block'").count() == 0


def test_exact_on_a_million_hosts(spark):
    hosts = spark.range(1_000_000, numPartitions=8).select(F.concat(F.lit("h"), "id", F.lit(".example")).alias("key"), (F.col("id") % 10 == 3).alias("listed"))
    cascade = U.BloomCascade(hosts)
    assert cascade.n_parts == 16
    assert cascade.mark(hosts, "key", "m").where("m <> listed").count() == 0
    # one host with a third of all rows
    hot = hosts.limit(2000).union(spark.range(1000).select(F.lit("h3.example"), F.lit(True)))
    assert cascade.mark(hot, "key", "m").where("m <> listed").count() == 0


def test_block_list_names_hosts_and_their_subdomains(spark):
    names = {r.host for r in U.block_list(spark).collect()}
    assert len(names) > 1500 and "casino-win.example.com" in names and "free-bets.example.org" in names and "spam.example.net" in names
    assert {r.asDict()["host"] for r in U.block_list(spark).groupBy("host").count().where("count > 1").collect()} == set()
    urls = ["http://m.Casino-Win.example.com/en/1", "http://casino-win.example.com.evil.org/", "http://win.example.com/", "http://not-casino-win.example.com/x", "http://a.b.spam-farm.example.com/de"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.filter_urls(df, U.block_list(spark)).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "allow", 4: "block"}
