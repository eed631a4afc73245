import datetime as dt
import glob
import gzip
import hashlib
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from quantloom.sources import markup, parsers, sniffed, store, xbrl
from tests.helpers import one


def payload(spark, text):
    return spark.createDataFrame([("i", text)], "instrument_id string, payload string")


def test_candles(spark):
    p = payload(spark, '{"data":{"candles":[["2026-01-01T00:00:00+05:30",1,2,0.5,1.5,10,0],["2026-01-02T00:00:00+05:30",1]]}}')
    r = one(parsers.candles(p, "payload", "instrument_id"))
    assert (r["ts"], r["close"], r["volume"]) == (dt.datetime(2025, 12, 31, 18, 30), 1.5, 10)
    assert parsers.short_candles(p, "payload", "instrument_id").count() == 1


def test_quotes_and_actions(spark):
    q = one(parsers.quotes(payload(spark, '{"data":{"K":{"last_price":5,"volume":7,"depth":{"buy":[{"orders":2}],"sell":[{"orders":3},{"price":1}]}}}}'), "payload"))
    assert (q["instrument_key"], q["last_price"], q["order_count"]) == ("K", 5, 5)
    a = one(parsers.corporate_actions(payload(spark, '{"data":[{"name":"Cash Dividend","amount":1200.5,"event_details":[{"name":"Ex Date","value":"05-02-2026"}]}]}'), "payload"))
    assert (a["action_type"], a["ex_date"], a["amount"]) == ("cash_dividend", dt.date(2026, 2, 5), 1200.5)


def test_statements(spark):
    text = '{"data":{"type":"standalone","time_period":"yearly","balance_sheet":[{"category":"Total Assets","history":[{"period":"Mar 2024","value":"1,000"},{"value":"9"}]}],"full_statement":[{"particular":"Cash","history":[{"period":"Mar 2024","value":"-"}]}]}}'
    out = {(r["part"], r["name"]): (r["period_end"], r["value"]) for r in parsers.statement_snapshots(payload(spark, text), "payload").collect()}
    assert out == {("summary", "Total Assets"): (dt.date(2024, 3, 31), 1000.0), ("full_statement", "Cash"): (dt.date(2024, 3, 31), None)}


def test_daily_file_and_instruments(spark):
    df = spark.createDataFrame([("ABC", "IN1", "01-Jan-2026", "1,000.5", "-"), (" ", None, "01-Jan-2026", "1", "1")], "`SYMBOL` string, `ISIN CODE` string, `DATE` string, `CLOSE_PRICE` string, `TURNOVER LACS` string")
    r = one(parsers.daily_universe(df))
    assert (r["instrument_id"], r["close"], r["traded_value"], r["ts"]) == ("IN1", 1000.5, None, dt.datetime(2025, 12, 31, 18, 30))


def test_feeds(spark):
    rss = '<rss><channel><title>x</title><item><title>A &amp;lt;b&amp;gt;B&amp;lt;/b&amp;gt;</title><link>http://u/1</link><description>text</description><pubDate>Mon, 05 Jan 2026 10:00:00 +0530</pubDate><guid>g</guid></item></channel></rss>'
    r = one(parsers.from_feed(payload(spark, rss), "payload", "instrument_id"))
    assert (r["title"], r["url"], r["published_at"]) == ("A B", "http://u/1", dt.datetime(2026, 1, 5, 4, 30)) and r["news_id"].startswith("news:")
    atom = '<feed><entry><title>T</title><link href="http://u/2"/><summary>s</summary><updated>2026-01-05T10:00:00Z</updated><id>i</id></entry></feed>'
    r = one(parsers.from_feed(payload(spark, atom), "payload"))
    assert (r["title"], r["url"], r["published_at"]) == ("T", "http://u/2", dt.datetime(2026, 1, 5, 10))


def test_pages(spark):
    html = '<html><script>x</script><p> a <b>b</b></p><table><tr><td>Jan 05, 2026</td><td><a href="/d/1.html">Order one</a> <a href="f.pdf">PDF</a></td></tr></table><a href="?p=2">Next ›</a></html>'
    df = spark.createDataFrame([("http://h/l/", html), ("http://h/e/", None)], "url string, html string")
    r = one(markup.listing_rows(df))
    assert (r["title"], r["detail_url"], r["date_text"], r["links"]) == ("Order one", "http://h/d/1.html", "Jan 05, 2026", ["http://h/d/1.html", "http://h/l/f.pdf"])
    assert one(markup.next_pages(df))["next_url"] == "http://h/l/?p=2"
    assert sorted(r["text"] for r in markup.visible_text(df).collect()) == ["", "a\nb\nJan 05, 2026\nOrder one\nPDF\nNext ›"]


def test_xbrl(spark):
    xml = """<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:f="urn:f">
    <context id="c"><entity><segment><d:explicitMember dimension="f:Axis">f:One</d:explicitMember></segment></entity><period><startDate>2025-04-01</startDate><endDate>2026-03-31</endDate></period></context>
    <unit id="u"><measure>INR</measure></unit><f:Revenue contextRef="c" unitRef="u" decimals="0" scale="3">1,234</f:Revenue><f:Gone contextRef="c" xsi:nil="true"/><f:Name contextRef="c">Words</f:Name></xbrl>"""
    df = spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "filing_id long, xml string")
    out = {r["concept"]: r for r in xbrl.facts(df).collect()}
    r = out["Revenue"]
    assert (r["value"], r["unit"], r["period_end"], r["dimensions"]) == (1_234_000.0, "INR", dt.date(2026, 3, 31), {"Axis": "f:One"})
    assert out["Gone"]["value"] is None and out["Name"]["text"] == "Words"
    assert sorted(r["filing_id"] for r in xbrl.unparsed(df).collect()) == [2, 3]


def test_documents_and_coercers(spark):
    df = spark.createDataFrame([("see https://a/b.pdf and https://a/c.zip, https://a/b.pdf", "1,234.5%", "31/12/2025")], "t string, n string, d string")
    assert [r["document_type"] for r in parsers.linked_assets(df, "t").orderBy("position").collect()] == ["pdf", "zip"]
    r = one(df.select(parsers.number(F.col("n")).alias("n"), parsers.day(F.col("d")).alias("d"), parsers.number(F.lit("N/A")).alias("x")))
    assert (r["n"], r["d"], r["x"]) == (1234.5, dt.date(2025, 12, 31), None)


def test_store_appends_once(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([("r1", "market"), ("r2", "news"), ("r2", "news")], "record_id string, domain string")
    assert store.load(spark, root, "canonical") is None
    store.append(df, root, "canonical")
    store.append(df.unionByName(spark.createDataFrame([("r3", "news")], df.schema)), root, "canonical")
    assert sorted(r["record_id"] for r in store.load(spark, root, "canonical").collect()) == ["r1", "r2", "r3"]
    assert store.load(spark, root, "canonical", "news").count() == 2
    raw = spark.createDataFrame([("s", bytearray(b"x")), ("s", bytearray(b"x")), ("t", bytearray(b"y"))], "source string, content binary")
    store.write_raw(raw, root)
    store.write_raw(raw, root)
    assert store.raw_files(spark, root).count() == 2 and store.corrupted(spark, root).count() == 0
    assert store.raw_manifest(raw).count() == 2


def test_landed_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"isin":"IN1","trading_symbol":"abc","exchange":"NSE"}\n\n{"isin":"","trading_symbol":"def","exchange":"NSE"}\n')
    out = parsers.instruments(parsers.read_landed(spark, str(tmp_path / "a.json.gz"), "json"))
    assert sorted(r["instrument_id"] for r in out.collect()) == ["IN1", "NSE:DEF"]


def test_dated_and_checked_raw(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("nse", '{"a":1}', dt.datetime(2026, 1, 5)), ("nse", '{"a":1}', dt.datetime(2026, 1, 5, 7)), ("nse", '{"a":1}', dt.datetime(2026, 1, 6))], "source string, content string, retrieved_at timestamp")
    store.write_dated(rows, root)
    store.write_dated(rows, root)
    assert spark.read.json(f"{root}/landed").count() == 2 and spark.read.json(f"{root}/landed/source=nse/year=2026/month=1/day=5").count() == 1
    raw = spark.createDataFrame([("s", bytearray(b"x"))], "source string, content binary")
    store.write_raw(raw, root)
    assert one(store.read_raw(spark, root))["content"] == bytearray(b"x")
    (path,) = glob.glob(f"{root}/raw/s/*/*.bin")
    pathlib.Path(path).write_bytes(b"y")
    assert store.corrupted(spark, root).count() == 1
    with pytest.raises(Exception, match="corrupted raw artifact"):
        store.read_raw(spark, root).collect()


def test_a_failed_write_is_never_seen(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path / "store"), "record_id string, domain string"
    store.append(spark.createDataFrame([("r1", "a")], schema), root, "canonical")
    more = spark.createDataFrame([(f"r{k}", "b") for k in range(1, 40)] + [(None, "a"), (None, "b")], schema)
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed between data and log")))
        with pytest.raises(OSError):
            store.append(more, root, "canonical")
    assert store.load(spark, root, "canonical").count() == 1
    for _ in range(2):
        store.append(more, root, "canonical")
    assert store.load(spark, root, "canonical").count() == 40
    assert {tuple(r) for r in store.load(spark, root, "canonical").where("record_id IN ('r1', 'r2')").collect()} == {("r1", "a"), ("r2", "b")}
    assert store.log(spark, root, "canonical").count() == 2  # the repeated append had nothing to add
    store.compact(spark, root, "canonical")
    assert store.load(spark, root, "canonical").count() == 40 and store.load(spark, root, "canonical", "b").count() >= 38
    assert store.batches(spark, root, "canonical").select("batch").distinct().count() == 1
    assert store.append(more, root, "canonical") is None and store.load(spark, root, "canonical").count() == 40


def test_appends_and_lookups_read_their_buckets(spark, tmp_path):
    root = str(tmp_path / "store")
    store.append(spark.range(500).selectExpr("concat('r', id) AS record_id", "'a' AS domain"), root, "canonical")
    found = store.lookup(spark, root, "canonical", "record_id", ["r7", "r8", "none"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {r["record_id"] for r in found.collect()} == {"r7", "r8"} and "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert len(glob.glob(f"{root}/canonical/batch=*/_bucket=*")) == store.BUCKETS
    assert store.load(spark, root, "none") is None and store.lookup(spark, root, "none", "record_id", ["x"]) is None


def test_raw_files_are_written_once_and_whole(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [("a b/c", bytearray(b"x"), "text/html; charset=utf-8"), ("a b/c", bytearray(b"x"), "text/html"), (None, bytearray(b""), None), ("s", None, None), ("s", bytearray(b"x"), "application/vnd.ms-excel")]
    df = spark.createDataFrame(rows, "source string, content binary, media_type string")
    store.write_raw(df, root)
    files = {p: pathlib.Path(p).stat().st_mtime_ns for p in glob.glob(f"{root}/raw/**/*.*", recursive=True)}
    x, empty = (hashlib.sha256(b).hexdigest() for b in (b"x", b""))
    assert {p.removeprefix(f"{root}/") for p in files} == {f"raw/a_b_c/{x[:2]}/{x}.html", f"raw/unknown/{empty[:2]}/{empty}.bin", f"raw/s/{x[:2]}/{x}.xls"}
    store.write_raw(df, root)
    assert files == {p: pathlib.Path(p).stat().st_mtime_ns for p in glob.glob(f"{root}/raw/**/*.*", recursive=True)}
    assert not glob.glob(f"{root}/_writing/*") and {bytes(r["content"]) for r in store.read_raw(spark, root, [x]).collect()} == {b"x"}
    assert {r["path"] for r in store.raw_manifest(df.where("content IS NOT NULL")).collect()} == {p.removeprefix(f"{root}/") for p in files}


def test_failed_raw_write_leaves_whole_files_only(spark, tmp_path):
    root = str(tmp_path / "store")
    bad = spark.range(40).selectExpr("'s' AS source", "CASE WHEN id = 37 THEN CAST(raise_error('lost') AS BINARY) ELSE CAST(CAST(id AS STRING) AS BINARY) END AS content")
    with pytest.raises(Exception, match="lost"):
        store.write_raw(bad, root)
    assert not glob.glob(f"{root}/_writing/*")
    if glob.glob(f"{root}/raw/*/*/*"):
        assert store.corrupted(spark, root).count() == 0
    store.write_raw(spark.range(40).selectExpr("'s' AS source", "CAST(CAST(id AS STRING) AS BINARY) AS content"), root)
    assert store.read_raw(spark, root).count() == 40


def test_files_are_told_by_their_first_bytes(spark, tmp_path):
    rows = [{"a": 1}, {"a": "é"}]
    lines = "\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n"
    files = {
        "array.txt": json.dumps([rows[0], 7, rows[1]]).encode(), "object.bin": json.dumps(rows[0], indent=1).encode(), "data.gz": json.dumps({"data": [*rows, 3], "x": 1}).encode(), "lines": lines.encode(),
        "packed": gzip.compress(lines.encode()), "packed.json": gzip.compress(json.dumps(rows).encode()), "members.gz": gzip.compress(b'{"a": 1}\n') + gzip.compress(b'{"a": "\xc3\xa9"}'), "bom": b"\xef\xbb\xbf" + lines.encode(),
        "empty": b"", "blank": b" \n \n", "number": b"5", "bad": b'{"a": 1}\n{"a":\n[1]\n', "cut.gz": gzip.compress(json.dumps(rows).encode())[:-12], "one.json": b'{"data": 5}', "pretty": json.dumps(rows, indent=2).encode(), "latin": b'[{"a": "\xe9"}]',
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found: dict = {}
    for r in sniffed.read_sniffed(spark, str(tmp_path)).orderBy("path", "rank").collect():
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append(json.loads(r["row"]) if r["row"] else r["code"])
    same = dict.fromkeys(("array.txt", "data.gz", "lines", "packed", "packed.json", "members.gz", "bom", "pretty"), rows)
    assert found.pop("cut.gz")
    assert found == same | {"object.bin": rows[:1], "number": ["unknown_shape"], "bad": [rows[0], "bad_line", "bad_line"], "one.json": [{"data": 5}], "latin": ["bad_line"]}


def test_nothing_landed_is_an_empty_table(spark, tmp_path):
    assert parsers.read_landed(spark, str(tmp_path / "none"), "json", schema="a string").count() == 0
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert parsers.read_landed(spark, str(tmp_path / "a.json"), "json", multiLine=True).count() == 2


def test_store_layout(spark, tmp_path):
    root = str(tmp_path / "store")
    records = spark.createDataFrame([("r1", "market"), ("r2", "news")], "record_id string, domain string")
    observed = spark.createDataFrame([("o1", "r1", "close", "a1"), ("o2", "r1", "open", None)], "observation_id string, canonical_record_id string, field string, raw_ref string")
    assert {r["problem"] for r in store.layout_problems(spark, root).collect()} == {"missing_table"}
    store.persist(records, observed, root)
    store.persist(records, observed, root)
    assert store.layout_problems(spark, root).count() == 0
    assert {r["table"]: r["rows"] for r in store.counted(spark, root).collect()} == {"canonical": 2, "observations": 2, "record_observations": 2, "observation_raw": 1}
    store.append(spark.createDataFrame([("r3", "news")], records.schema), root, "canonical")
    assert [tuple(r) for r in store.layout_problems(spark, root).collect()] == [("canonical", "other_rows")]
    raw = spark.createDataFrame([("s", bytearray(b"x"), "text/html; charset=utf-8"), ("s", bytearray(b"y"), None)], "source string, content binary, media_type string")
    assert sorted(r["path"].rsplit(".", 1)[1] for r in store.raw_manifest(raw).collect()) == ["bin", "html"]


def test_xbrl_is_read_in_one_pass(spark):
    """F3, F16: facts were opened by a round over the table for each level, and each filing was parsed again for each."""
    xml = (
        '<?xml version="1.0" encoding="ISO-8859-1"?><xbrl xmlns:x="u"><x:context id="01"><scenario><d:typedMember dimension="f:T"><v>1</v></d:typedMember><d:explicitMember dimension="f:A"> f:B </d:explicitMember></scenario><period><instant>2024-01-31T00:00:00</instant></period></x:context>'
        '<unit id="r"><divide><unitNumerator><measure>INR</measure></unitNumerator><unitDenominator><measure>s</measure></unitDenominator></divide></unit><unit id="p"/>'
        + "<f:T>" * 40 + '<f:EPS contextRef="01" unitRef="r">-007.50</f:EPS><f:N contextRef="01" unitRef="p"><![CDATA[a & b]]></f:N><f:None contextRef="gone"/>' + "</f:T>" * 40 + "</xbrl>"
    )
    df = spark.createDataFrame([(1, xml), (2, xml + "<")], "filing_id long, xml string")
    found = xbrl.facts(df)
    assert "from_xml" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r["concept"]: (r["text"], None if r["value"] is None else float(r["value"]), r["unit"], r["instant"], r["dimensions"]) for r in found.collect()}
    assert got == {"EPS": ("-7.5", -7.5, "INR", dt.date(2024, 1, 31), {"A": "f:B"}), "N": ("a & b", None, "p", dt.date(2024, 1, 31), {"A": "f:B"}), "None": (None, None, None, None, {})}
    assert [r["filing_id"] for r in xbrl.unparsed(df).collect()] == [2]
