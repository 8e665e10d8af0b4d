"""Queries that write tables in a format, read them back and answer from what they read; streams; maintenance."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.log import as_timestamp
from eventloom.operators import healing, maintenance
from eventloom.plans import ingest, pipeline
from eventloom.plans.registry import E, log, query
from eventloom.session import scratch, shares, table
from eventloom.sources import detect, readers, sinks, stores
from eventloom.streaming import streams

EVENT_SQL = "SELECT event_id, user_id, event_type, value FROM events"
COUNT_SQL = "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1"


def counted(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def written(s, d, kind: str, **options) -> str:
    path = scratch(s, f"io-{kind}")
    events = table(s, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("string").alias("ts"), "value")
    writer = events.write
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.format(kind).save(path)
    return path


query("src01_csv", COUNT_SQL)(lambda s, d: counted(readers.csv(s, written(s, d, "csv", header=True))))
query("src01_tsv", COUNT_SQL)(lambda s, d: counted(readers.read(s, written(s, d, "csv", header=True, sep="\t"), "tsv")))
query("src02_typed_csv", EVENT_SQL)(lambda s, d: readers.typed_csv(s, written(s, d, "csv", header=True)).select("event_id", "user_id", "event_type", "value"))
query("src07_json_document", "SELECT n_nationkey, n_name FROM nation")(lambda s, d: (lambda p: (table(s, d, "nation").coalesce(1).agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(p), readers.json(s, p, "n_nationkey int, n_name string", lines=False))[1])(scratch(s, "doc")))
query("src08_jsonl", COUNT_SQL)(lambda s, d: counted(readers.json(s, written(s, d, "json"))))
query("src10_json_text", "SELECT event_id::VARCHAR AS event_id, event_type FROM events")(lambda s, d: readers.json(s, written(s, d, "json"), as_text=True, mode="DROPMALFORMED").select("event_id", "event_type"))
query("src12_parquet", COUNT_SQL)(lambda s, d: counted(readers.parquet(s, written(s, d, "parquet"))))
query("src23_gzip", COUNT_SQL)(lambda s, d: counted(readers.csv(s, written(s, d, "csv", header=True, compression="gzip"))))
query("src24_orc", COUNT_SQL)(lambda s, d: counted(readers.read(s, written(s, d, "orc"), "orc")))
query("src04_event_csv", E + " SELECT case_id, activity, timestamp FROM e")(lambda s, d: readers.event_csv(s, written(s, d, "csv", header=True), "user_id", "event_type", "ts").select("case_id", "activity", "timestamp"))
query("src11_event_json", E + " SELECT case_id, activity, timestamp FROM e")(lambda s, d: readers.event_json(s, written(s, d, "json"), "user_id", "event_type", "ts").select("case_id", "activity", "timestamp"))
query("src22_pushed_down", "SELECT event_id, value FROM events WHERE event_type = 'view' AND value > 20")(lambda s, d: readers.parquet(s, f"{d}/events.parquet").where("event_type = 'view' and value > 20").select("event_id", "value"))
query("src25_registry", "SELECT unnest(['accesslog', 'csv', 'json', 'jsonl', 'orc', 'parquet', 'tsv', 'xes', 'xlsx']) AS kind")(lambda s, d: s.createDataFrame([(k,) for k in sorted(readers.READERS)], "kind string"))


def lines(s, rows: DataFrame, name: str) -> str:
    path = scratch(s, name)
    rows.write.text(path)
    return path


@query("src03_robust_csv", "SELECT event_id, CASE event_id % 4 WHEN 1 THEN NULL ELSE event_type END AS event_type, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS n FROM events")
def _robust(s, d) -> DataFrame:
    text = F.expr("CASE event_id % 4 WHEN 0 THEN concat(event_id, ',', event_type, ',extra') WHEN 1 THEN cast(event_id as string) WHEN 2 THEN concat('\"', event_id, '\",', event_type) ELSE concat(event_id, ',', event_type) END")
    found = readers.robust_csv(s, lines(s, table(s, d, "events").select(text.alias("value")), "robust"), ["event_id", "event_type"])
    return found.select(F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("_fields").alias("n"))


@query("src05_csv_errors", "SELECT event_id % 10 = 0 AS bad, count(*) AS n FROM events GROUP BY 1")
def _errors(s, d) -> DataFrame:
    rows = table(s, d, "events").select("user_id", "event_type", F.when(F.col("event_id") % 10 == 0, "soon").otherwise(F.col("ts").cast("string")).alias("ts"))
    path = scratch(s, "errors")
    rows.write.option("header", True).csv(path)
    return readers.event_csv(s, path, "user_id", "event_type", "ts", on_error="quarantine").groupBy(F.col("error").isNotNull().alias("bad")).agg(F.count(F.lit(1)).alias("n"))


@query("src06_union_csv", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE -1 END AS value FROM events")
def _union(s, d) -> DataFrame:
    events, a, b = table(s, d, "events"), scratch(s, "union-a"), scratch(s, "union-b")
    events.where("event_id % 2 = 0").select("event_id", "value").write.option("header", True).csv(a)
    events.where("event_id % 2 = 1").select("event_type", "event_id").write.option("header", True).csv(b)
    return readers.union_csv(s, [a, b]).select(F.col("event_id").cast("long").alias("event_id"), F.coalesce("value", F.lit(-1.0)).alias("value"))


@query("src13_xes", E + " SELECT case_id, activity, timestamp, coalesce(resource, '') AS resource FROM e")
def _xes(s, d) -> DataFrame:
    one = F.format_string('<event><string key="concept:name" value="%s"/><date key="time:timestamp" value="%s"/>%s</event>', "activity", F.date_format(as_timestamp("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.coalesce(F.format_string('<string key="org:resource" value="%s"/>', "resource"), F.lit("")))
    one = F.when(F.col("resource").isNull(), F.regexp_replace(one, '<string key="org:resource" value="null"/>', "")).otherwise(one)
    events = log(s, d)
    # the text is some twenty times as long as the table
    events = events.repartition(shares(*[events] * 20), "case_id").withColumn("x", one)
    traces = events.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "seq", "x"))), lambda e: e["x"]), "").alias("body"))
    values = traces.select(F.concat(F.lit('<trace><string key="concept:name" value="'), "case_id", F.lit('"/>'), "body", F.lit("</trace>")).alias("value"))

    def rooted(batches):  # a file has one root
        yield pd.DataFrame({"value": ["<log>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</log>"]})

    document = values.mapInPandas(rooted, "value string")
    return readers.xes(s, lines(s, document, "xes")).select("case_id", "activity", "timestamp", F.coalesce("resource", F.lit("")).alias("resource"))


@query("src16_access_log", "SELECT '10.0.0.' || user_id AS case_id, '/' || event_type AS activity, epoch_us(date_trunc('second', ts)) * 1000 AS timestamp, CAST(200 AS INTEGER) AS status, event_id AS bytes FROM events")
def _access(s, d) -> DataFrame:
    line = F.concat(F.lit("10.0.0."), "user_id", F.lit(" - - ["), F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), "event_type", F.lit('?q=1 HTTP/1.1" 200 '), F.col("event_id").cast("string"))
    return readers.access_log(s, lines(s, table(s, d, "events").select(line.alias("value")), "access")).select("case_id", "activity", "timestamp", "status", "bytes")


def workbook_bytes(rows: list[list[str]]) -> bytes:
    """A small workbook with inline text cells."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in r) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


@query("src15_xlsx_cells", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def _xlsx(s, d) -> DataFrame:
    nations = table(s, d, "nation").select(F.col("n_nationkey").cast("string"), "n_name").collect()  # 25 rows
    path = stores.put(s, f"{scratch(s, 'book')}/nations.xlsx", workbook_bytes([["id", "name"], *[list(r) for r in nations]]))
    return readers.read(s, path).select("id", "name")


query("src15_day_numbers", "SELECT * FROM (VALUES (45292.5, TIMESTAMP '2024-01-01 12:00:00'), (1.0, TIMESTAMP '1900-01-01 00:00:00'), (61.0, TIMESTAMP '1900-03-01 00:00:00')) t(days, day)")(lambda s, d: s.createDataFrame([(45292.5,), (1.0,), (61.0,)], "days double").withColumn("day", readers.excel_time(F.col("days"))))
NUMBERS = [("a.txt", b"0123456789"), ("a2.txt", b"x" * 70), ("deep/b.txt", b"")]


def stored(s) -> str:
    folder = scratch(s, "objects")
    for name, data in NUMBERS:
        stores.put(s, f"{folder}/{name}", data)
    return folder


query("src18_files", "SELECT * FROM (VALUES ('a.txt', 10::BIGINT), ('a2.txt', 70)) t(name, length)")(lambda s, d: readers.files(s, f"{stored(s)}/a*.txt").select(F.substring_index("path", "/", -1).alias("name"), "length"))
query("src21_listing", "SELECT * FROM (VALUES ('a.txt', 10::BIGINT), ('a2.txt', 70), ('b.txt', 0)) t(name, size)")(lambda s, d: stores.listing(s, stored(s)).select(F.substring_index("path", "/", -1).alias("name"), "size"))
query("src21_listing_by_prefix", "SELECT 'a2.txt' AS name")(lambda s, d: stores.listing(s, stored(s), "a2").select(F.substring_index("path", "/", -1).alias("name")))
query("src21_range", "SELECT '3456' AS part, '0123456789' AS whole")(lambda s, d: (lambda f: s.createDataFrame([(stores.read_range(s, f"{f}/a.txt", 3, 4).decode(), b"".join(stores.get(s, f"{f}/a.txt")).decode())], "part string, whole string"))(stored(s)))
query("snk17_parts", "SELECT 3 * 1048576 + 5 AS size, true AS same")(lambda s, d: _parts(s))


def _parts(s) -> DataFrame:
    parts = [bytes([65 + k]) * stores.PART for k in range(3)] + [b"tail!"]
    path = stores.put(s, f"{scratch(s, 'parts')}/big.bin", iter(parts))
    back = list(stores.get(s, path))
    return s.createDataFrame([(sum(map(len, back)), b"".join(back) == b"".join(parts))], "size int, same boolean")


@query("ql05_parquet_marks", "SELECT * FROM (VALUES ('sound', ''), ('cut', 'no mark at the end'), ('text', 'no mark at the start'), ('short', 'too small'), ('none', 'no such file')) t(name, problem)")
def _marks(s, d) -> DataFrame:
    folder = scratch(s, "marks")
    table(s, d, "nation").coalesce(1).write.parquet(f"{folder}/sound")
    sound = next(x.path for x in stores.listed(s, f"{folder}/sound") if x.path.endswith(".parquet"))
    data = b"".join(stores.get(s, sound))
    paths = {"sound": sound, "none": f"{folder}/none"}
    for name, part in (("cut", data[:-3]), ("text", b"x" * 50), ("short", data[:5])):
        paths[name] = stores.put(s, f"{folder}/{name}.parquet", part)
    return s.createDataFrame([(n, stores.parquet_problem(s, p) or "") for n, p in paths.items()], "name string, problem string")


@query("src19_http", "SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name FROM nation")
def _http(s, d) -> DataFrame:
    """A table served on this machine, behind basic authentication, whose format only the content type tells."""
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    rows = table(s, d, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    body = ("id,name\n" + "".join(f"{r[0]},{r[1]}\n" for r in rows)).encode()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            known = self.headers.get("Authorization") == "Basic bWU6c2VjcmV0"
            self.send_response(200 if known else 401)
            self.send_header("Content-Type", "text/csv; charset=utf-8")
            self.end_headers()
            self.wfile.write(body if known else b"")

        def log_message(self, *args) -> None:
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        return readers.http(s, f"http://127.0.0.1:{server.server_port}/nations?all=1", scratch(s, "http"), user="me", password="secret").select(F.col("id").cast("int").alias("id"), "name")
    finally:
        server.shutdown()


@query("src09_json_text", "SELECT CAST(n_nationkey AS VARCHAR) AS id, '{\"name\":\"' || n_name || '\"}' AS nested FROM nation")
def _json_text(s, d) -> DataFrame:
    path = scratch(s, "jsontext")
    table(s, d, "nation").agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name")).alias("nested")))).alias("value")).write.text(path)
    return readers.json_text(s, path).select("id", "nested")


@query("src14_typed_xes", E + " SELECT case_id, activity, 'cost' AS key, 'float' AS type, CAST(CAST(seq AS INTEGER) AS VARCHAR) AS value FROM e WHERE seq < 50")
def _typed_xes(s, d) -> DataFrame:
    events = log(s, d).where("seq < 50")
    one = F.format_string('<event><string key="concept:name" value="%s"/><float key="cost" value="%s"/></event>', "activity", F.col("seq").cast("string"))
    traces = events.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "seq", one.alias("x")))), lambda e: e["x"]), "").alias("body"))
    document = traces.agg(F.concat(F.lit("<log>"), F.array_join(F.collect_list(F.concat(F.lit('<trace><string key="concept:name" value="'), "case_id", F.lit('"/>'), "body", F.lit("</trace>"))), ""), F.lit("</log>")).alias("value"))
    return readers.typed_xes(s, lines(s, document, "typedxes")).select("case_id", "activity", F.explode("attributes").alias("a")).select("case_id", "activity", "a.key", "a.type", "a.value")


@query("snk16_quarantine", "SELECT CASE WHEN event_id % 3 = 0 THEN 'column' ELSE 'time' END AS kind, count(*) AS n FROM events WHERE event_id % 3 <> 2 GROUP BY 1")
def _quarantine(s, d) -> DataFrame:
    folder = scratch(s, "quarantine")
    _, bad = healing.split_errors(table(s, d, "events").select("event_id"), F.when(F.col("event_id") % 3 == 0, "column count").when(F.col("event_id") % 3 == 1, "time: does not parse"))
    sinks.quarantine(bad, folder, "events")
    return sinks.quarantined(s, folder, "events").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


query("snk08_arrow_parts", EVENT_SQL)(lambda s, d: sinks.read_arrow_parts(sinks.arrow_parts(table(s, d, "events").select("event_id", "user_id", "event_type", "value"), 1000), "event_id long, user_id long, event_type string, value double"))


@query("sc07_catalogue", "SELECT * FROM (VALUES ('databases', 'raw,sales'), ('tables of sales', 'nations'), ('after the drop', '')) t(what, names)")
def _catalogue(s, d) -> DataFrame:
    store = maintenance.Catalogue(s, scratch(s, "catalogue"))
    for name in ("sales", "raw", "gone"):
        store.create_database(name, "a test")
    store.create_table("sales", "nations", table(s, d, "nation"))
    store.drop_database("gone")
    rows = [("databases", ",".join(store.databases())), ("tables of sales", ",".join(store.tables("sales")))]
    store.drop_table("sales.nations")
    return s.createDataFrame([*rows, ("after the drop", ",".join(store.tables("sales")))], "what string, names string")


query("src20_memory", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(id, name)")(lambda s, d: readers.memory(s, "id,name\n1,a\n2,b\n"))
SAMPLES = (("a,b,c\n1,2,3\n4,5,6\n", "csv", ","), ("a\tb\n1\t2\n", "tsv", "\t"), ('{"a": 1}\n{"a": 2}\n', "jsonl", ""), ("[{\"a\": 1}]", "json", ""), ("<?xml version='1.0'?><log></log>", "xes", ""), ("a;b\n1;2\n", "csv", ";"), ('1.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 1', "accesslog", ""))
query("det02_formats", "SELECT * FROM (VALUES (0, 'csv'), (1, 'tsv'), (2, 'jsonl'), (3, 'json'), (4, 'xes'), (5, 'csv'), (6, 'accesslog'), (7, 'gzip'), (8, 'parquet')) t(i, kind)")(
    lambda s, d: s.createDataFrame([(i, detect.format_of(x.encode())) for i, (x, _, _) in enumerate(SAMPLES)] + [(7, detect.format_of(gzip.compress(b"a"))), (8, detect.format_of(b"PAR1"))], "i int, kind string")
)
query("det01_encodings", "SELECT unnest(['ascii', 'utf-8', 'utf-8-sig', 'utf-16-le', 'latin-1']) AS encoding")(lambda s, d: s.createDataFrame([(detect.encoding(x),) for x in (b"a", "é".encode(), b"\xef\xbb\xbfa", b"\xff\xfea\x00", b"caf\xe9 ")], "encoding string"))
query("det03_delimiters", "SELECT * FROM (VALUES (0, ','), (1, chr(9)), (5, ';')) t(i, delimiter)")(lambda s, d: s.createDataFrame([(i, detect.delimiter(x)) for i, (x, _, w) in enumerate(SAMPLES) if w], "i int, delimiter string"))
query("det05_headers", "SELECT * FROM (VALUES (0, true), (1, false)) t(i, header)")(lambda s, d: s.createDataFrame([(i, detect.has_header(x)) for i, x in enumerate(("id,name\n1,a\n", "1,a\n2,b\n"))], "i int, header boolean"))
query("det07_analysis", "SELECT 'csv' AS format, ',' AS delimiter, true AS header, 3 AS columns, 'fast' AS strategy")(lambda s, d: (lambda a: s.createDataFrame([(a.format, a.delimiter, a.header, a.columns, a.strategy)], "format string, delimiter string, header boolean, columns int, strategy string"))(detect.analyse(SAMPLES[0][0].encode())))
query("det08_date_order", "SELECT unnest(['DMY', 'MDY', 'YMD']) AS date_order")(lambda s, d: s.createDataFrame([(detect.date_order(x),) for x in (["13/02/2024"], ["02/13/2024"], ["2024-02-13"])], "date_order string"))

# sinks
query("snk01_codecs", "SELECT unnest(['gzip', 'none', 'snappy', 'zstd']) AS codec, (SELECT count(*) FROM events) AS n")(lambda s, d: _codecs(s, d))


def _codecs(s, d) -> DataFrame:
    out = None
    for name in ("none", "snappy", "gzip", "zstd"):
        path = scratch(s, f"codec-{name}")
        sinks.write_parquet(table(s, d, "events"), path, name)
        part = s.read.parquet(path).agg(F.lit(name).alias("codec"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("snk02_lineage", "SELECT * FROM (VALUES ('source_file', 'events.parquet'), ('version', '1')) t(key, value)")
def _lineage(s, d) -> DataFrame:
    path = scratch(s, "lineage")
    sinks.write_parquet(table(s, d, "events"), path, lineage={"source_file": "events.parquet", "version": 1})
    return s.createDataFrame(list(sinks.lineage_of(s.read.parquet(path)).items()), "key string, value string")


@query("snk04_sorted", COUNT_SQL)
def _sorted(s, d) -> DataFrame:
    path = scratch(s, "sorted")
    sinks.write_parquet(table(s, d, "events"), path, sort_by=["user_id", "ts"])
    return counted(s.read.parquet(path))


@query("snk07_partitioned", "SELECT strftime(ts, '%Y-%m-%d') AS ts_day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _partitioned(s, d) -> DataFrame:
    path = scratch(s, "partitioned")
    sinks.write_table(table(s, d, "events"), path, {"ts": "day", "event_type": "identity"})
    return s.read.parquet(path).groupBy(F.col("ts_day").cast("string").alias("ts_day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


query("snk07_manifest", "SELECT count(*) AS n_rows FROM events")(lambda s, d: sinks.manifest(s, written(s, d, "parquet")).agg(F.sum("n_rows").alias("n_rows")))
query("snk10_partition_values", "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS m, left(o_orderpriority, 3) AS t FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", sinks.partition_value("o_orderdate", "year").alias("y"), sinks.partition_value("o_orderdate", "month").alias("m"), sinks.partition_value("o_orderpriority", "truncate", width=3).alias("t")))
query("snk09_discarded", "SELECT count(*) AS n FROM nation")(lambda s, d: s.createDataFrame([(sinks.discard(table(s, d, "nation")),)], "n long"))


@query("snk15_dead_letters", "SELECT 'malformed_row' AS error_type, count(*) FILTER (event_id % 3 = 0) AS n FROM events UNION ALL SELECT 'invalid_timestamp', count(*) FILTER (event_id % 3 = 1) FROM events")
def _dead(s, d) -> DataFrame:
    path = scratch(s, "dead")
    _, bad = healing.split_errors(table(s, d, "events").select("event_id"), F.when(F.col("event_id") % 3 == 0, "wrong column count").when(F.col("event_id") % 3 == 1, "not a time"))
    sinks.write_dead_letters(bad, path, source="events")
    return sinks.summarise_dead_letters(sinks.read_dead_letters(s, path)).select("error_type", "n")


# streams
def _stream(s, d) -> DataFrame:
    return streams.read_folder(s, d, s.read.parquet(f"{d}/events.parquet").schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(s, stream: DataFrame, mode: str = "append") -> DataFrame:
    path, checkpoint = scratch(s, "stream"), scratch(s, "stream-checkpoint")
    if mode == "append":
        streams.run_available(stream, path, checkpoint)
    else:
        streams.for_each_batch(stream, checkpoint, lambda df, n: df.write.mode("overwrite").parquet(path), mode)
    return s.read.parquet(path)


query("str01_stream", "SELECT event_id FROM events WHERE event_type = 'view'")(lambda s, d: _streamed(s, _stream(s, d).where("event_type = 'view'").select("event_id")))
query("str07_stream_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")(lambda s, d: _streamed(s, streams.deduplicated(_stream(s, d), ["user_id", "event_type"], "ts", "400 days").select("user_id", "event_type")).agg(F.count(F.lit(1)).alias("n")))
query("str08_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: _streamed(s, streams.windowed_counts(_stream(s, d), "ts", "event_type", "1 day"), "complete").select("start", "event_type", "n"))
query("str08_sliding", "SELECT time_bucket(INTERVAL 1 DAY, ts) - to_days(k) AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")(lambda s, d: _streamed(s, streams.windowed_counts(_stream(s, d), "ts", "event_type", "2 days", "1 day"), "complete").select("start", "event_type", "n"))
query("str08_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*) AS n FROM n GROUP BY user_id, k")(
    lambda s, d: _streamed(s, streams.session_counts(_stream(s, d), "ts", "user_id", "6 hours"), "complete").select("user_id", "n")
)


@query("str07_stream_dfg", E + ", f AS (SELECT activity, lead(activity) OVER (PARTITION BY case_id ORDER BY timestamp, seq) AS next_activity FROM e) SELECT activity, next_activity, count(*) AS n FROM f WHERE next_activity IS NOT NULL GROUP BY 1, 2")
def _stream_dfg(s, d) -> DataFrame:
    rows = _stream(s, d).select(F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("activity"), (F.unix_micros("ts") * 1000).alias("timestamp"), F.col("event_id").alias("seq"))
    return _streamed(s, streams.directly_follows(rows)).groupBy("activity", "next_activity").agg(F.count(F.lit(1)).alias("n"))


@query("str03_observed", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _observed(s, d) -> DataFrame:
    return pipeline.Pipeline([lambda x: x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))]).observed(table(s, d, "events"))[0]


@query("str02_chain", COUNT_SQL)
def _chain(s, d) -> DataFrame:
    return pipeline.Pipeline().then(lambda x: x.where("value is not null")).then(counted).apply(table(s, d, "events"))


def _marked(event: dict) -> dict | None:
    return {**event, "event_type": event["event_type"].upper()} if event["value"] > 5 else None


query("udf01_function", "SELECT event_id, upper(event_type) AS event_type, value FROM events WHERE value > 5")(lambda s, d: pipeline.Pipeline([pipeline.processor(_marked)]).apply(table(s, d, "events").select("event_id", "event_type", "value")))
query("str05b_safe_steps", COUNT_SQL)(lambda s, d: pipeline.Pipeline([pipeline.safe(lambda x: pipeline.PLUGINS["no such step"](x)), pipeline.checkpointed(counted)]).apply(table(s, d, "events")))


@query("str05b_dead_letters", "SELECT 'good' AS part, count(*) FILTER (value > 5) AS n FROM events UNION ALL SELECT 'bad', count(*) FILTER (value <= 5) FROM events UNION ALL SELECT 'traced', count(*) FILTER (value > 5) FROM events")
def _steps(s, d) -> DataFrame:
    path, trace = scratch(s, "steps"), pipeline.Trace()
    count = trace.traced("good", pipeline.with_dead_letters(lambda x: x, lambda x: F.when(F.col("value") <= 5, "column too small"), path, "events"))
    good = sinks.discard(count(table(s, d, "events")))
    return s.createDataFrame([("good", good), ("bad", sinks.read_dead_letters(s, path).count()), ("traced", trace.rows()["good"])], "part string, n long")


@query("ing01_presets", "SELECT unnest(['high_quality', 'high_speed', 'low_memory']) AS preset, (SELECT count(*) FROM events) AS n, (SELECT round(sum(value), 2) FROM events) AS total")
def _presets(s, d) -> DataFrame:
    source, rows = written(s, d, "csv", header=True), []
    for preset in ingest.INGEST:
        r = ingest.ingest(s, source, scratch(s, f"preset-{preset}"), preset).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).first()
        rows.append((preset, r["n"], r["total"]))
    return s.createDataFrame(rows, "preset string, n long, total double")


@query("ing02_batches", "SELECT * FROM (VALUES (0, 'a,b'), (1, 'c'), (2, 'd,e,f'), (3, 'g')) t(batch, files)")
def _batches(s, d) -> DataFrame:
    files = [stores.Stored(p, n, 0) for p, n in zip("gfedcba", (5, 1, 1, 1, 20, 5, 4), strict=True)]
    return s.createDataFrame([(i, ",".join(b)) for i, b in enumerate(ingest.batches(files, 10, 3))], "batch int, files string")


@query("str05_resumed", "SELECT (SELECT count(*) FROM events) AS n, (SELECT round(sum(value), 2) FROM events) AS total, true AS stopped, true AS resumed")
def _resumed(s, d) -> DataFrame:
    """An ingest that stops after its first batch, and another that goes on from there."""
    source, to, progress = scratch(s, "source"), scratch(s, "table"), f"{scratch(s, 'progress')}/state.json"
    table(s, d, "events").select("event_id", "value").repartition(4).write.option("header", True).csv(source)
    first = ingest.ingest_folder(s, source, to, progress, target=1, most_batches=1)
    second = ingest.ingest_folder(s, source, to, progress, target=1)
    out = s.read.parquet(to).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.withColumn("stopped", F.lit(len(first.done) == 1 and first.started)).withColumn("resumed", F.lit(len(second.done) == 4))


query("snk05_event_parquet", E + " SELECT case_id, activity, timestamp, CAST('' AS VARCHAR) AS resource FROM e")(lambda s, d: (lambda p: (sinks.write_parquet(readers.event_csv(s, written(s, d, "csv", header=True), "user_id", "event_type", "ts"), p), s.read.parquet(p).select("case_id", "activity", "timestamp", F.coalesce("resource", F.lit("")).alias("resource")))[1])(scratch(s, "roles")))


@query("udf02_plugin", "SELECT count(*) AS n FROM events WHERE value > 10")
def _plugin(s, d) -> DataFrame:
    pipeline.PLUGINS["large_values"] = lambda x: x.where("value > 10")
    return pipeline.Pipeline(["large_values"]).apply(table(s, d, "events")).agg(F.count(F.lit(1)).alias("n"))


@query("udf04_sql_function", "SELECT event_id, round(value * 2, 2) AS doubled FROM events")
def _udf(s, d) -> DataFrame:
    table(s, d, "events").createOrReplaceTempView("eventloom_events")
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION eventloom_double(x DOUBLE) RETURNS DOUBLE RETURN round(x * 2, 2)")
    return s.sql("SELECT event_id, eventloom_double(value) AS doubled FROM eventloom_events")


# maintenance
@query("mt01_compaction", "SELECT count(*) AS n, true AS fewer FROM events")
def _compaction(s, d) -> DataFrame:
    a, b = scratch(s, "many"), scratch(s, "few")
    table(s, d, "events").repartition(12).write.parquet(a)
    plan = maintenance.compact(s, a, b, sort_by=["user_id", "ts"])
    after = maintenance.plan_compaction(s, b)
    return s.read.parquet(b).agg(F.count(F.lit(1)).alias("n")).withColumn("fewer", F.lit(after.files < plan.files and maintenance.wants_compaction(plan, 10)))


@query("sc08_snapshots", "SELECT * FROM (VALUES (1, (SELECT count(*) FROM nation)), (2, 2 * (SELECT count(*) FROM nation)), (3, (SELECT count(*) FROM region))) t(version, n)")
def _snapshots(s, d) -> DataFrame:
    tables = maintenance.Catalogue(s, scratch(s, "catalogue"))
    names = table(s, d, "nation").select(F.col("n_name").alias("name"))
    tables.write("names", names)
    tables.write("names", names)
    tables.write("names", table(s, d, "region").select(F.col("r_name").alias("name")), mode="overwrite")
    return s.createDataFrame([(v, tables.read("names", v).count()) for v in (1, 2, 3)], "version int, n long")


query("ag25_metric_stats", "SELECT event_type AS name, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS largest, count(*) AS n FROM events GROUP BY 1")(lambda s, d: maintenance.metric_stats(table(s, d, "events").select(F.col("event_type").alias("name"), "value")))
query("mt03_job_stats", "SELECT count(*) AS n_jobs, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus = 'P') AS n_failed, CAST(sum(o_orderkey) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_rows FROM orders")(
    lambda s, d: maintenance.job_stats(table(s, d, "orders").select(F.expr("CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'open' END").alias("state"), F.col("o_orderkey").alias("n_rows")))
)
TIMES = ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05.250000", "2024/01/02", "13/02/2024", "02-Jan-2024 03:04:05", "45293", "soon")
query("fn_timestamps", "SELECT * FROM (VALUES (0, '2024-01-02 03:04:05'), (1, '2024-01-02 03:04:05'), (2, '2024-01-02 00:00:00'), (3, '2024-02-13 00:00:00'), (4, '2024-01-02 03:04:05'), (5, '2024-01-02 00:00:00'), (6, 'none')) t(i, parsed)")(
    lambda s, d: s.createDataFrame(list(enumerate(TIMES)), "i int, x string").select("i", F.coalesce(F.date_format(readers.parse_time(F.col("x")), "yyyy-MM-dd HH:mm:ss"), F.lit("none")).alias("parsed"))
)
query("fn_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofweek(o_orderdate) AS INTEGER) AS dow, CAST(weekofyear(o_orderdate) AS INTEGER) AS w, epoch_ms(o_orderdate) AS ms FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), (F.dayofweek("o_orderdate") - 1).alias("dow"), F.weekofyear("o_orderdate").alias("w"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))
)
query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")))
query("fn_path", "SELECT '/a/b' AS path")(lambda s, d: s.range(1).select(readers.request_path(F.lit("GET /a/b?x=1 HTTP/1.1")).alias("path")))
