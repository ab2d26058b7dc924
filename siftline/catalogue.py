"""Every query of the engine by name, with the SQL that must give the same rows.

The test tables hold no line files, so lines are made from events (many repeated keys) and taken
from documents (real commas, quotes and signs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import JobConfig
from .functions import normalize as N
from .functions import record as R
from .operators import chunks, dedup, grammar
from .plans.job import DedupJob, normalized_records, run_dedup
from .plans.workspace import Workspace
from .sources import discover_csv, read_lines
from .sources.lines import ORDER
from .streaming import stream_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and a line made from it, a third of them in the name:secret form."""
    e = F.col("event_id")
    name = F.when(e % 2 == 0, "User").otherwise("user")
    line = F.concat(name, F.col("user_id"), F.lit("@example.com"), F.when(e % 3 == 0, ":").otherwise(","), F.col("event_type"), F.lit(",https://Site"), (e % 7), F.lit(".example.com/"), F.lit(" x"), (e % 5))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


def quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with quoted separators, doubled and open quotes."""
    e = F.col("event_id")
    secret = F.when(e % 4 == 0, F.concat(F.lit('"a,'), "event_type", F.lit('"'))).when(e % 4 == 1, F.concat(F.lit('"x""y:'), "event_type", F.lit('"'))).when(e % 4 == 2, F.concat(F.lit('p"q r"'), "event_type")).otherwise(F.concat(F.lit('"open,'), "event_type"))
    line = F.concat(F.lit('"u@h"'), F.col("user_id"), F.when(e % 3 == 0, ":").otherwise(","), secret, F.lit(',"w w",t '), (e % 5), F.when(e % 6 == 0, ",").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def parsed(lines: DataFrame) -> DataFrame:
    return grammar.parse_lines(lines, "line").drop("line")


def keyed(spark: SparkSession, sf_dir: str, kind: str = "username", case_sensitive: bool = False) -> DataFrame:
    return parsed(rec_lines(spark, sf_dir)).withColumn("key", R.record_key(kind, case_sensitive))


def _flat(df: DataFrame, *more: str) -> DataFrame:
    return df.select("event_id", "username", "password", "url", F.array_join("extra_fields", "|").alias("extra"), *more)


def _variants(url: Column) -> Column:
    """The url, and forms of other schemes made from it."""
    rest = F.regexp_replace(url, "^https?://", "")
    return F.explode(F.array(url, F.upper(url), F.concat(F.lit("android://k@"), rest), F.concat(F.lit("ftp://"), rest, F.lit("/")), F.concat(F.lit("mailto:me@"), rest), F.concat(F.lit("mailto://me@"), rest), F.concat(F.lit("https://www."), rest)))


# -- queries ---------------------------------------------------------------------------------------------------------


def scan_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir).withColumn("line_no", F.col("line_no").cast("long"))


def clean_line_filter(spark, sf_dir):
    return grammar.clean_lines(scan_lines(spark, sf_dir), "line")


def parse_fields(spark, sf_dir):
    return _flat(parsed(rec_lines(spark, sf_dir)))


def parse_quoted(spark, sf_dir):
    return _flat(parsed(quoted_lines(spark, sf_dir)))


def parse_pandas(spark, sf_dir):
    return _flat(grammar.parse_lines(quoted_lines(spark, sf_dir), "line", form="pandas").drop("line"))


def parse_reject_reasons(spark, sf_dir):
    return grammar.reject_reasons(scan_lines(spark, sf_dir), "line").groupBy("reason").agg(F.count("*").alias("n"))


def normalize_username(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.normalize_username(F.col("c_name")).alias("name"))


def ascii_lower(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.ascii_lower(F.col("text")).alias("low"))


def normalize_url(spark, sf_dir):
    forms = table(spark, sf_dir, "pages").select("page_id", _variants(F.col("url")).alias("form"))
    return forms.select("page_id", "form", N.normalize_url(F.col("form")).alias("url"))


def normalize_host(spark, sf_dir):
    forms = table(spark, sf_dir, "pages").select("page_id", _variants(F.col("url")).alias("form"))
    return forms.select("page_id", "form", N.normalize_host(F.col("form")).alias("host"))


def string_helpers(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", N.detect_protocol(url).cast("long").alias("scheme"), N.starts_with(url, "https").alias("secure"), N.find_char(url, "/").cast("long").alias("first"), N.find_last_char(url, "/").cast("long").alias("last"), N.find_last_char(url, "#").cast("long").alias("mark"))


def batch_normalize(spark, sf_dir):
    every = normalized_records(parsed(rec_lines(spark, sf_dir)).drop("event_id"))
    return every.withColumn("all_fields", F.array_join("all_fields", "|")).groupBy(*[c for c in every.columns]).agg(F.count("*").alias("n"))


def dedup_key_ci(spark, sf_dir):
    return keyed(spark, sf_dir).select("event_id", "key")


def dedup_key_cs(spark, sf_dir):
    return keyed(spark, sf_dir, case_sensitive=True).select("event_id", "key")


def field_count(spark, sf_dir):
    return parsed(rec_lines(spark, sf_dir)).select("event_id", R.field_count(F.col("url"), F.col("extra_fields")).cast("long").alias("n"))


def estimated_size(spark, sf_dir):
    return parsed(rec_lines(spark, sf_dir)).select("event_id", R.estimated_size(*map(F.col, grammar.RECORD)).cast("long").alias("n"))


def email_filter(spark, sf_dir):
    names = parsed(rec_lines(spark, sf_dir)).select("username").unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("username")))
    return names.where(N.is_email(F.col("username"))).groupBy("username").agg(F.count("*").alias("n"))


def dedup_first_ci(spark, sf_dir):
    return _flat(dedup.dedup_first(keyed(spark, sf_dir), ["key"], ["event_id"]), "key")


def dedup_first_cs(spark, sf_dir):
    return _flat(dedup.dedup_first(keyed(spark, sf_dir, case_sensitive=True), ["key"], ["event_id"]), "key")


def dedup_by_url_key(spark, sf_dir):
    return _flat(dedup.dedup_first(keyed(spark, sf_dir, "username_url"), ["key"], ["event_id"]), "key")


def dedup_min_by(spark, sf_dir):
    return dedup.keep_smallest(keyed(spark, sf_dir), ["key"], "event_id", ["event_id", "url"])


def intra_chunk_dedup(spark, sf_dir):
    runs = keyed(spark, sf_dir).withColumn("run", F.col("event_id") % 4)
    return dedup.dedup_in_runs(runs, "run", ["key"], ["event_id"]).select("run", "key", "event_id")


def merge_dedup(spark, sf_dir):
    runs = intra_chunk_dedup(spark, sf_dir)
    return dedup.merge_dedup([runs.where(F.col("run") == i) for i in range(4)], ["key"], ["event_id"]).select("key", "event_id")


def sort_dedup(spark, sf_dir):
    ordered = dedup.sort_dedup(keyed(spark, sf_dir).withColumn("line", R.to_csv_line(*map(F.col, grammar.RECORD))).select("key", "event_id", "line"), "key", ["event_id"])
    return dedup.with_position(ordered, Workspace(spark, "sort-dedup"))


def doc_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("text")).alias("body"))
    return dedup.dedup_first(docs, ["body"], ["doc_id"]).select("doc_id")


def to_csv_line(spark, sf_dir):
    return parsed(rec_lines(spark, sf_dir)).select("event_id", R.to_csv_line(*map(F.col, grammar.RECORD)).alias("line"))


def record_json(spark, sf_dir):
    back = parsed(rec_lines(spark, sf_dir)).select("event_id", R.record_from_json(R.record_json()).alias("r"))
    return back.select("event_id", "r.username", "r.password", "r.url", F.array_join("r.extra_fields", "|").alias("extra"), "r.normalized_username", "r.normalized_url")


def chunk_metadata(spark, sf_dir):
    rows = keyed(spark, sf_dir).withColumn("file", F.col("event_id") % 4)
    rows = rows.withColumns({"line": R.to_csv_line(*map(F.col, grammar.RECORD)), "size": R.estimated_size(*map(F.col, grammar.RECORD)).cast("long")})
    return chunks.chunk_report(rows, "file", "event_id", "size", "key", "line", 20_000)


def chunk_estimates(spark, sf_dir):
    size = F.col("n_chars")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", chunks.estimate_chunk_count(size, 1024).alias("chunks"), chunks.estimate_merge_ms(size).alias("merge_ms"))


def run_stats(spark, sf_dir):
    rows = keyed(spark, sf_dir).withColumn("file", F.col("event_id") % 4)
    return rows.agg(F.count("*").alias("total"), F.countDistinct("key").alias("unique_records"), (F.count("*") - F.countDistinct("key")).alias("duplicates"), F.countDistinct("file").alias("files"))


def streamed_dedup(spark, sf_dir):
    """Two arrivals of files, the second of lines that were all seen before in part."""
    place = Workspace(spark, "stream-dedup")
    lines = rec_lines(spark, sf_dir)
    for name, part in (("a", lines.where("event_id % 4 < 2")), ("b", lines.where("event_id % 4 >= 1"))):
        part.select("line").write.mode("append").option("lineSep", "\n").text(place.path("arrived"))
        stream_dedup(spark, place.path("arrived"), place.path("out"), place.path("state")).awaitTermination()
        del name
    return spark.read.schema("key string, line string").parquet(place.path("out")).select("key")


def _line_files(spark: SparkSession, sf_dir: str, place: Workspace, hidden: bool = False) -> str:
    """A folder of four line files in the order of events, and files that are none; with hidden, some lines that aren't UTF-8 and a hidden file."""
    line = F.when(F.col("event_id") % 97 == 0, F.concat("line", F.unhex(F.lit("FF")).cast("string"))).otherwise(F.col("line")) if hidden else F.col("line")
    lines = rec_lines(spark, sf_dir).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(line.alias("line"))
    lines.write.option("lineSep", "\n").text(place.path("written"))
    store, top = place.file_system(place.path("files"))
    store.mkdirs(top)
    parts = sorted(p for p in place.children(place.path("written")) if p.startswith("part-"))
    for i, part in enumerate(parts):
        name = ".third.CSV" if hidden and i == 2 else f"file-{i}.csv"
        store.rename(place.file_system(place.path(f"written/{part}"))[1], place.file_system(place.path(f"files/{name}"))[1])
    place.write_text(place.path("files/notes.txt"), "no,records\n")
    return place.path("files")


def _with_places(spark: SparkSession, place: Workspace, paths: list[str]) -> DataFrame:
    """(pos, line) of the lines of files, in order."""
    return dedup.with_position(read_lines(spark, paths).orderBy(*ORDER), place, "placed").select("pos", F.col("value").alias("line"))


def read_line_files(spark, sf_dir):
    """Discovery and scan: a hidden file counts, other files don't, lines that aren't UTF-8 go alone."""
    folder = _line_files(spark, sf_dir, Workspace(spark, "read-lines"), hidden=True)
    return read_lines(spark, discover_csv(spark, folder)).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def single_file_output(spark, sf_dir):
    """The whole job: files in, one ordered file out, read again."""
    place = Workspace(spark, "single-file")
    paths = discover_csv(spark, _line_files(spark, sf_dir, place))
    run_dedup(spark, paths, place.path("out/all.csv"), JobConfig(temp_directory=place.path("temp")))
    return _with_places(spark, place, [place.path("out/all.csv")])


def part_files_output(spark, sf_dir):
    """The job by user and address, into ordered part files, read again."""
    place = Workspace(spark, "part-files")
    paths = discover_csv(spark, _line_files(spark, sf_dir, place))
    run_dedup(spark, paths, place.path("out"), JobConfig(temp_directory=place.path("temp")), key="username_url", single_file=False)
    return _with_places(spark, place, [place.path(f"out/{p}") for p in sorted(place.children(place.path("out"))) if p.startswith("part-")])


def resume_job(spark, sf_dir):
    """A job over half of the files, gone on with over all of them: what it counted, and how many files it had staged before."""
    place = Workspace(spark, "resume")
    paths = discover_csv(spark, _line_files(spark, sf_dir, place))
    config = JobConfig(temp_directory=place.path("temp"))
    run_dedup(spark, paths[:2], place.path("half.csv"), config, files_per_batch=1)
    before = set(place.children(place.path("temp")))
    job = DedupJob(spark, config, files_per_batch=1)
    stats = job.run(paths, place.path("all.csv"), resume=True)
    kept = len(paths[:2]) if before == set(place.children(place.path("temp"))) else 0
    job.cleanup()
    row = (stats.total_records, stats.unique_records, stats.duplicates_removed, stats.files_processed, kept, place.exists(place.path("temp")))
    return spark.createDataFrame([row], "total long, unique_records long, duplicates long, files long, resumed long, left_over boolean")


_NAMES = """scan_lines clean_line_filter parse_fields parse_quoted parse_pandas parse_reject_reasons normalize_username
ascii_lower normalize_url normalize_host string_helpers batch_normalize dedup_key_ci dedup_key_cs field_count estimated_size
email_filter dedup_first_ci dedup_first_cs dedup_by_url_key dedup_min_by intra_chunk_dedup merge_dedup sort_dedup doc_dedup
to_csv_line record_json chunk_metadata chunk_estimates run_stats read_line_files single_file_output part_files_output resume_job""".split()
QUERIES = {name: globals()[name] for name in _NAMES} | {"stream_dedup": streamed_dedup}

# -- SQL -------------------------------------------------------------------------------------------------------------

_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CC = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_REC = """rec as (select event_id, user_id, event_type,
  concat(case when event_id % 2 = 0 then 'User' else 'user' end, user_id, '@example.com', case when event_id % 3 = 0 then ':' else ',' end,
  event_type, ',https://Site', event_id % 7, '.example.com/', ' x', event_id % 5) as line from events)"""
_QUOTED = """rec as (select event_id,
  concat('"u@h"', user_id, case when event_id % 3 = 0 then ':' else ',' end,
  case event_id % 4 when 0 then concat('"a,', event_type, '"') when 1 then concat('"x""y:', event_type, '"') when 2 then concat('p"q r"', event_type) else concat('"open,', event_type) end,
  ',"w w",t ', event_id % 5, case when event_id % 6 = 0 then ',' else '' end) as line from events)"""
_LINES = """lines as (select doc_id, unnest(generate_series(1, len(a))) - 1 as line_no, unnest(a) as line
  from (select doc_id, string_split(text, chr(10)) as a from documents))"""


def _parse(source: str, columns: str, mark: str) -> str:
    """CTEs from `source` (columns, line) to `parsed`: the grammar of operators.grammar by regular expressions."""
    opened = lambda c: _trim(f"translate({c}, '\x01\x02\x03', ',: ')")
    lead, tail = r"^([^,@]*(?:@[^,:]*)?)([,:]|\z)", r"([^,@ ]*(?:@[^,: ]*)?)([,: ]|\z)"
    return f"""
  t0 as (select {columns}, {_trim("coalesce(line, '')")} as line from {source}),
  t1 as (select {columns}, line, case when line = '' then 'empty' when strlen(line) > 40960 then 'long' when regexp_matches(line, '{_CC}') then 'binary' end as fault from t0),
  t2 as (select {columns}, fault, string_split(case when fault is null then line else '' end, '"') as s from t1),
  t3 as (select {columns}, fault, array_to_string(list_transform(s, lambda x, i: case when i % 2 = 0 then translate(x, ',: ', '\x01\x02\x03') when x = '' and i > 1 and i < len(s) then '"' else x end), '') as m from t2),
  t4 as (select *, regexp_extract(m, '{lead}', 1) as f1 from t3),
  t5 as (select *, length(m) > length(f1) as d1, substr(m, length(f1) + 2) as r1 from t4),
  t6 as (select *, regexp_extract(r1, '{lead}', 1) as f2 from t5),
  t7 as (select *, d1 and length(r1) > length(f2) as d2, substr(r1, length(f2) + 2) as r2 from t6),
  t8 as (select *, case when d2 then regexp_extract_all(r2, '{tail}', 1) else []::varchar[] end as e, case when d2 then regexp_extract_all(r2, '{tail}', 2) else []::varchar[] end as z from t7),
  t9 as (select *, list_transform(case when d2 and len(e) > 0 and e[-1] = '' and (len(e) = 1 or true) then e[1:len(e) - {mark}] else e end, lambda x: {opened("x")}) as tail from t8),
  t10 as (select {columns}, fault, {opened("f1")} as username, case when d1 then {opened("f2")} else '' end as password, d1 and (d2 or {opened("f2")} <> '') as two,
    case when len(tail) > 0 and tail[-1] = '' and z[len(tail)] = '' then tail[1:len(tail) - 1] else tail end as tail from t9),
  t11 as (select {columns}, fault, two, username, password, coalesce(tail[1], '') as url, tail[2:] as extra_fields from t10),
  reasons as (select *, coalesce(fault, case when not two then 'fields' when username = '' then 'username' when strlen(username) > 4096 or strlen(password) > 4096 or strlen(url) > 4096 then 'field_length' end, 'ok') as reason from t11),
  parsed as (select {columns}, username, password, url, extra_fields from reasons where reason = 'ok')"""


_URL = """case when lower({0}) like 'android://%' then regexp_replace(split_part(substr(lower({0}), 11), '@', 1), '/$', '')
  else regexp_replace(regexp_replace(lower({0}), '^(https?://|ftp://|mailto:)', ''), '/$', '') end"""
_HOST = f"""translate(regexp_extract(regexp_replace(case when {{0}} like 'android://%' then regexp_replace(substr({{0}}, 11), '^.*@', '', 's')
  else regexp_replace({{0}}, '^(https?://|ftp://|mailto:/)', '') end, '^www\\.', ''), '^[^/?#]*', 0), '{_UP}', '{_LOW}')"""
_FORMS = """forms as (select page_id, unnest([url, upper(url), 'android://k@' || rest, 'ftp://' || rest || '/', 'mailto:me@' || rest, 'mailto://me@' || rest, 'https://www.' || rest]) as form
  from (select page_id, url, regexp_replace(url, '^https?://', '') as rest from pages))"""
_PARSED = f"with {_REC}, {_parse('rec', 'event_id', '1')}"
_KEY_CI, _KEY_CS = "lower(username) || ':' || password", "username || ':' || password"
_EXTRA = "array_to_string(extra_fields, '|') as extra"
_LINE = "concat_ws(',', username, password, case when url <> '' then url end, case when len(extra_fields) > 0 then array_to_string(extra_fields, ',') end)"
_SIZE = "strlen(username) + strlen(password) + strlen(url) + coalesce(list_sum(list_transform(extra_fields, lambda x: strlen(x))), 0)::bigint + 256"


def _first(keys: str, source: str, columns: str) -> str:
    return f"select {columns} from (select *, row_number() over (partition by {keys} order by event_id) as rn from {source}) where rn = 1"


ORACLE_SQL = {
    "scan_lines": f"with {_LINES} select doc_id, line_no, line from lines",
    "clean_line_filter": f"with {_LINES}, t as (select doc_id, line_no, {_trim('line')} as line from lines) select * from t where line <> '' and strlen(line) <= 40960 and not regexp_matches(line, '{_CC}')",
    "parse_fields": f"{_PARSED} select event_id, username, password, url, {_EXTRA} from parsed",
    "parse_quoted": f"with {_QUOTED}, {_parse('rec', 'event_id', '1')} select event_id, username, password, url, {_EXTRA} from parsed",
    "parse_pandas": f"with {_QUOTED}, {_parse('rec', 'event_id', '1')} select event_id, username, password, url, {_EXTRA} from parsed",
    "parse_reject_reasons": f"with {_LINES}, {_parse('lines', 'doc_id, line_no', '1')} select reason, count(*) as n from reasons group by reason",
    "normalize_username": "select c_custkey, lower(c_name) as name from customer",
    "ascii_lower": f"select doc_id, translate(text, '{_UP}', '{_LOW}') as low from documents",
    "normalize_url": f"with {_FORMS} select page_id, form, {_URL.format('form')} as url from forms",
    "normalize_host": f"with {_FORMS} select page_id, form, {_HOST.format('form')} as host from forms",
    "string_helpers": "select page_id, length(regexp_extract(url, '^(https?://|android://|ftp://|mailto:/)', 1)) as scheme, starts_with(url, 'https') as secure, instr(url, '/') - 1 as first, case when instr(url, '/') > 0 then length(url) - instr(reverse(url), '/') else -1 end as last, case when instr(url, '#') > 0 then length(url) - instr(reverse(url), '#') else -1 end as mark from pages",
    "batch_normalize": f"""{_PARSED} select username as user, password, url, translate(username, '{_UP}', '{_LOW}') as normalized_user, {_HOST.format('url')} as normalized_url,
      2 + (case when url <> '' then 1 else 0 end) + len(extra_fields) as field_count, array_to_string(list_concat([username, password], list_concat(case when url <> '' then [url] else [] end, extra_fields)), '|') as all_fields, count(*) as n from parsed group by all""",
    "dedup_key_ci": f"{_PARSED} select event_id, {_KEY_CI} as key from parsed",
    "dedup_key_cs": f"{_PARSED} select event_id, {_KEY_CS} as key from parsed",
    "field_count": f"{_PARSED} select event_id, 2 + (case when url <> '' then 1 else 0 end) + len(extra_fields) as n from parsed",
    "estimated_size": f"{_PARSED} select event_id, {_SIZE} as n from parsed",
    "email_filter": rf"{_PARSED}, names as (select username from parsed union all select c_name from customer) select username, count(*) as n from names where regexp_matches(username, '^[^@\s]+@[^@\s]+\.[^@\s]+$') group by username",
    "dedup_first_ci": f"{_PARSED}, k as (select *, {_KEY_CI} as key from parsed) {_first('key', 'k', f'event_id, username, password, url, {_EXTRA}, key')}",
    "dedup_first_cs": f"{_PARSED}, k as (select *, {_KEY_CS} as key from parsed) {_first('key', 'k', f'event_id, username, password, url, {_EXTRA}, key')}",
    "dedup_by_url_key": f"{_PARSED}, k as (select *, lower(username) || ':' || {_URL.format('url')} as key from parsed) {_first('key', 'k', f'event_id, username, password, url, {_EXTRA}, key')}",
    "dedup_min_by": f"{_PARSED}, k as (select *, {_KEY_CI} as key from parsed) {_first('key', 'k', 'key, event_id, url')}",
    "intra_chunk_dedup": f"{_PARSED}, k as (select *, {_KEY_CI} as key, event_id % 4 as run from parsed) {_first('run, key', 'k', 'run, key, event_id')}",
    "merge_dedup": f"{_PARSED}, k as (select *, {_KEY_CI} as key, event_id % 4 as run from parsed), runs as ({_first('run, key', 'k', 'run, key, event_id')}) {_first('key', 'runs', 'key, event_id')}",
    "sort_dedup": f"{_PARSED}, k as (select event_id, {_KEY_CI} as key, {_LINE} as line from parsed), u as ({_first('key', 'k', 'key, event_id, line')}) select key, event_id, line, row_number() over (order by key) as pos from u",
    "doc_dedup": "select doc_id from (select doc_id, row_number() over (partition by lower(trim(text, ' ')) order by doc_id) as rn from documents) where rn = 1",
    "to_csv_line": f"{_PARSED} select event_id, {_LINE} as line from parsed",
    "record_json": f"{_PARSED} select event_id, username, password, url, {_EXTRA}, lower(username) as normalized_username, {_URL.format('url')} as normalized_url from parsed",
    "chunk_metadata": f"""with recursive {_REC}, {_parse('rec', 'event_id', '1')},
      sized as (select event_id, event_id % 4 as file, {_KEY_CI} as key, {_LINE} as line, {_SIZE} as size, row_number() over (partition by event_id % 4 order by event_id) as i from parsed),
      fold as (select file, i, size as filled, 0::bigint as chunk_no from sized where i = 1
        union all select s.file, s.i, case when f.filled + s.size > 20000 then s.size else f.filled + s.size end, f.chunk_no + case when f.filled + s.size > 20000 then 1 else 0 end from fold f join sized s on s.file = f.file and s.i = f.i + 1),
      placed as (select s.*, f.chunk_no, row_number() over (partition by s.file, f.chunk_no, s.key order by event_id) as rn from sized s join fold f on f.file = s.file and f.i = s.i)
      select file, chunk_no, count(*) as records_read, count(*) filter (rn = 1) as record_count, sum(strlen(line) + 1) filter (rn = 1)::bigint as file_size_bytes from placed group by file, chunk_no""",
    "chunk_estimates": "select doc_id, greatest(1, ceil(n_chars / 1024.0))::bigint as chunks, greatest(1000, floor(n_chars * 0.001))::bigint as merge_ms from documents",
    "run_stats": f"{_PARSED}, k as (select {_KEY_CI} as key, event_id % 4 as file from parsed) select count(*) as total, count(distinct key) as unique_records, count(*) - count(distinct key) as duplicates, count(distinct file) as files from k",
    "read_line_files": f"with {_REC} select line, count(*) as n from rec where event_id % 97 <> 0 group by line",
    "single_file_output": f"{_PARSED}, k as (select event_id, {_KEY_CI} as key, {_LINE} as line from parsed), u as ({_first('key', 'k', 'key, line')}) select row_number() over (order by key) as pos, line from u",
    "part_files_output": f"{_PARSED}, k as (select event_id, lower(username) || ':' || {_URL.format('url')} as key, {_LINE} as line from parsed), u as ({_first('key', 'k', 'key, line')}) select row_number() over (order by key) as pos, line from u",
    "resume_job": f"{_PARSED}, k as (select {_KEY_CI} as key from parsed) select count(*) as total, count(distinct key) as unique_records, count(*) - count(distinct key) as duplicates, 4 as files, 2 as resumed, false as left_over from k",
    "stream_dedup": f"{_PARSED} select distinct {_KEY_CI} as key from parsed",
}
