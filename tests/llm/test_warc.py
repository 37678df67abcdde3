import hashlib

from corpusgraph.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string"
LONG = "<p>same payload é</p>" * 10


def rows():
    out = [(i, f"http://WWW.site{i % 3}.example.com/p/{i}?q=1#f", f"<p>page {i}</p>" * (i % 7 * 5), "clash") for i in range(700)]
    return [*out, (900, "http://a.b/", LONG, None), (800, "http://c.d", LONG, None), (801, None, LONG, ""), (1000, "no scheme\n here", None, ""), (1001, "http://x/ y", "", ""),
            (1002, "http://s/", "short", ""), (1003, "http://s/", "short", ""), (800, "http://c.d", LONG, None), (None, None, LONG, None), (None, "http://n/", None, None)]


def brute(data):
    first = {}
    for i, _, html, _ in data:
        p = (html or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, _, html, _ in data:
        p = (html or "").encode()
        to = first.get(p)
        to = None if to == i else to
        out.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_round_trip_matches_brute_force(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = sorted(((str(r[0]), *r[1:]) for r in W.round_trip(df).collect()), key=str)
    assert got == brute(rows())
    assert W.round_trip(df.limit(0)).count() == 0


def test_lookup_through_both_levels(spark):
    data = [r for r in rows() if r[0] is not None]
    folder, slices = W.archive_pages(spark.createDataFrame(data, SCHEMA))
    known = W.load_slices(slices)
    assert len(known) > 1 and slices.agg({"n": "sum"}).first()[0] == len(data) and slices.agg({"n_blocks": "sum"}).first()[0] >= 3
    reader = W.Reader(folder, known)
    for i, url, html, _ in data[::17]:
        (fields, payload), *_ = map(W.parse_record, reader.lookup(W.url_key(url), i))
        assert fields["X-Page-ID"] == str(i)
        if fields["WARC-Type"] == "response":
            assert payload == (html or "").encode()
        assert reader.payload(W.url_key(url), i) == (html or "").encode()
    assert reader.payload(W.url_key(None), 801) == LONG.encode()  # through the response
    assert list(reader.lookup("com,absent)/", 1)) == list(reader.lookup("", 1)) == [] and reader.payload("zz", 5) is None


def test_captures_that_repeat_and_long_payloads(spark):
    """One key and id in many rows (over blocks and files), and a long page."""
    data = [(5, "http://h/", f"payload {i} " * 3, None) for i in range(900)] + [(6, "http://h/z", "é" * 2_000_000, None), (None, "http://h/", "", None)]
    got = W.round_trip(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == brute(data)


def test_url_keys():
    assert W.url_key("https://WWW.Example.com/a/b?c#d") == "com,example,www)/a/b?c"
    assert W.url_key("http://x.y") == "y,x)/" and W.url_key(None) == ")/"


def test_headers_lead_back_to_their_keys(spark):
    for url in ("http://a.com/x\ny", "http://a.com/x y\tz", "http://b.org/\x01\x7f\x85?q= ", "\x0b http://c.net", "http://d.com/\xa0"):
        assert W.url_key(W._clean(url)) == W.url_key(url) and " " not in W.url_key(url) and len(W.url_key(url).splitlines()) == 1
    data = [(1, "http://a.com/x\ny", LONG, None), (2, "http://b.com/\x01", LONG, None), (3, None, LONG, None)]
    folder, slices = W.archive_pages(spark.createDataFrame(data, SCHEMA))
    reader = W.Reader(folder, W.load_slices(slices))
    assert {reader.payload(W.url_key(u), i) for i, u, *_ in data} == {LONG.encode()}


def test_a_third_of_all_pages_with_one_payload_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    data = [(i if i % 50 else None, f"http://h{i % 9}/{i}", LONG if i % 3 == 0 else f"{'own ' * 30}{i // 2 if i % 5 else i}", None) for i in range(1500)]
    got = W.round_trip(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == brute(data)
