"""Sources and sinks: payloads, OCR results, spreadsheets, JSON lines, snapshots."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import PurePosixPath
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.gazetteer import HEADERS
from ..functions.text import alias_key, image_stem_plain, normalize_url, safe_filename, url_extension

LINE = "struct<text:string,score:double,box:array<array<double>>>"
OCR = f"image string, image_path string, engine string, elapsed double, error string, mean_score double, lines array<{LINE}>, meta map<string,string>"
PAYLOAD = "datas struct<tables:array<struct<notice_id:string,notice_title:string,organization_name:string,notice_release_time:string,notice_type_name:string,notice_content:string>>,page:struct<total:bigint>>"
SNAPSHOT = "manual-source"

# JSON and text --------------------------------------------------------------------------------


def notices(spark: SparkSession, path: str) -> DataFrame:
    """Rows of saved notice payloads, renamed and trimmed."""
    names = {"notice_id": "notice_id", "notice_title": "notice_title", "organization_name": "organization", "notice_release_time": "release_time", "notice_type_name": "notice_type", "notice_content": "html"}
    rows = spark.read.schema(PAYLOAD).json(path, multiLine=True).select(F.explode("datas.tables").alias("t"))
    return rows.select(*[F.trim(F.col(f"t.{a}")).alias(b) for a, b in names.items()])


def tags(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{tag}\b[^>]*>)"), 1)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in either quotes or none; '' where it is absent."""
    for_quotes = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}([^{q}]*){q}", 1) for q in ('"', "'")]
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\s\"'>]+)", 1)
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (*for_quotes, bare)], F.lit(""))


def images(notice: DataFrame, html: str = "html") -> DataFrame:
    """Image URLs and alternative texts with their place in a notice, from 1; placeholders dropped."""
    from ..operators.predicates import placeholder_url

    rows = notice.select("*", F.posexplode(tags(F.col(html), "img")).alias("position", "tag")).withColumn("position", F.col("position") + 1)
    rows = rows.withColumn("image_url", normalize_url(F.trim(attribute(F.col("tag"), "src")))).withColumn("alt", attribute(F.col("tag"), "alt"))
    return rows.filter(~placeholder_url(F.col("image_url"))).drop("tag", html)


def first_by_url(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("image_url").orderBy(*order))).filter("_n = 1").drop("_n")


def image_names(rows: DataFrame) -> DataFrame:
    """File names of images: date, notice, place and text."""
    date = F.regexp_replace(F.substring("release_time", 1, 10), "[^0-9]", "")
    return rows.withColumn("file_name", F.concat(F.concat_ws("_", date, "notice_id", F.lpad(F.col("position").cast("string"), 2, "0"), safe_filename(F.col("alt"))), url_extension(F.col("image_url"))))


def crawl_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("downloaded"), F.count_if(F.col("status") != "ok").alias("failed"))


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and undecodable ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def ocr_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """OCR documents of a folder, and how many files couldn't be read. Files whose names begin with _ don't count."""
    raw = spark.read.schema(OCR + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    named = raw.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).filter(~F.startswith("file", F.lit("_")))
    good = F.col("_corrupt").isNull() & F.col("image").isNotNull()
    return named.filter(good).drop("_corrupt"), named.agg(F.count_if(~good).alias("corrupt"))


def write_ocr_results(results: DataFrame, path: str) -> None:
    """OCR documents as JSON, a line each, without the file column of ``ocr_results``."""
    results.select(*[c for c in results.columns if c != "file"]).write.mode("overwrite").json(path)


def image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Records of all metadata files by base name of the image; the last file, then the last record, wins."""
    record = "array<struct<notice_id:string,notice_title:string,organization:string,release_time:string,notice_type:string,image_url:string,alt:string,local_path:string,sha256:string>>"
    rows = spark.read.schema(f"records {record}").json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("records").alias("pos", "r"))
    rows = rows.withColumn("name", F.element_at(F.split(F.col("r.local_path"), r"[/\\]"), -1)).filter("name <> ''")
    best = Window.partitionBy("name").orderBy(F.desc("file"), F.desc("pos"))
    return rows.withColumn("n", F.row_number().over(best)).filter("n = 1").select("name", "r.*")


def filename_metadata(stem: Column) -> Column:
    """struct(date, notice_id, seq, alt) of YYYYMMDD_id_seq_alt; null for other names."""
    parts = F.split(stem, "_")
    date = F.concat_ws("-", F.substring(parts[0], 1, 4), F.substring(parts[0], 5, 2), F.substring(parts[0], 7, 2))
    found = F.struct(date.alias("date"), F.get(parts, F.lit(1)).alias("notice_id"), F.get(parts, F.lit(2)).try_cast("int").alias("seq"), F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "_").alias("alt"))
    return F.when((F.size(parts) >= 3) & parts[0].rlike("^[0-9]{8}$"), found)


def binary_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Files below a folder with hash and size, by name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("size_bytes"))


def side_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("stem"), F.col("value").alias("source_text"))


def enhancement_scale(width: Column, height: Column, least: int = 1200, most: int = 4000) -> Column:
    """Factor that brings an image's short side up to a minimum and its long side down to a maximum."""
    short, long = F.least(width, height), F.greatest(width, height)
    up = F.when(short < least, F.lit(float(least)) / short).otherwise(1.0)
    return F.when(long * up > most, F.lit(float(most)) / long).otherwise(up)


def recognize(rows: DataFrame, engines: Sequence[tuple[str, Callable[[], Callable[[bytes], list]]]]) -> DataFrame:
    """OCR by the first engine that loads; each Python worker loads it once. ``rows``: image, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, engine, problems = None, None, []
        for name, load in engines:
            try:
                engine = load()
                break
            except ImportError as e:
                problems.append(f"{name}: {e}")
        for batch in batches:
            out = []
            for image, content in zip(batch["image"], batch["content"]):
                lines, error = [], "; ".join(problems) if engine is None else None
                if engine is not None:
                    try:
                        lines = engine(bytes(content))
                    except Exception as e:  # noqa: BLE001 - a bad image is a row with an error
                        error = str(e)
                out.append((image, name if engine else None, error, lines))
            yield pd.DataFrame(out, columns=["image", "engine", "error", "lines"])

    return rows.select("image", "content").mapInPandas(run, f"image string, engine string, error string, lines array<{LINE}>")


# Spreadsheets ---------------------------------------------------------------------------------

_HEADER_OF = {re.sub(r"\s+", "", a).lower(): field for field, names in HEADERS.items() for a in names}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
HEADER_ROWS = 20


def header_fields(cells: Sequence[object]) -> dict[int, str]:
    """Column numbers of known fields, the first of a field winning."""
    out: dict[int, str] = {}
    for i, c in enumerate(cells):
        field = _HEADER_OF.get(re.sub(r"\s+", "", str(c or "")).lower())
        if field and field not in out.values():
            out[i] = field
    return out


def table_rows(rows: Iterator[Sequence[object]]) -> list[dict]:
    """Rows below the first header of a sheet as fields with their row numbers; no header: nothing.

    Later rows that are headers themselves, or have no name, are left out.
    """
    fields: dict[int, str] = {}
    out = []
    for number, cells in enumerate(rows, 1):
        if not fields:
            if number > HEADER_ROWS:
                return []
            found = header_fields(cells)
            # A title that reads like the name column's is no header.
            fields = found if "name" in found.values() and len(found) > 1 else {}
            continue
        row = {f: None if i >= len(cells) or cells[i] is None else str(cells[i]) for i, f in fields.items()}
        name = (row.get("name") or "").strip()
        if name and _HEADER_OF.get(name.lower()) is None and len(header_fields(cells)) < 3:
            out.append({"source_row": number, **row})
    return out


def xlsx_sheets(content: bytes) -> Iterator[Iterator[list]]:
    """Rows of each sheet, by the standard library alone; shared and inline strings, numbers and booleans."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(f"{_REL}id")]
        yield _sheet_rows(book.read(target.lstrip("/") if target.startswith("/") else str(PurePosixPath("xl") / target)), shared)


def _sheet_rows(xml: bytes, shared: Sequence[str]) -> Iterator[list]:
    at = 0
    for _, row in ElementTree.iterparse(io.BytesIO(xml)):
        if row.tag != f"{_MAIN}row":
            continue
        number = int(row.get("r") or at + 1)
        yield from ([] for _ in range(at + 1, number))
        at = number
        cells: list = []
        for c in row.iter(f"{_MAIN}c"):
            letters = re.match("[A-Z]*", c.get("r") or "").group()
            column = 0
            for x in letters:
                column = 26 * column + ord(x) - 64
            cells += [None] * (max(column, len(cells) + 1) - len(cells))
            kind, v = c.get("t"), c.find(f"{_MAIN}v")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif v is None or v.text is None:
                value = None
            else:
                value = shared[int(v.text)] if kind == "s" else bool(int(v.text)) if kind == "b" else v.text
            cells[(column or len(cells)) - 1] = value
        yield cells
        row.clear()


def csv_text(content: bytes) -> str:
    """UTF-8 with or without a mark, else GBK."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("gbk")


def spreadsheet_rows(name: str, content: bytes) -> list[dict]:
    """Rows of a file by its suffix; of a workbook, those of the first sheet with a header."""
    import csv

    suffix = PurePosixPath(name.lower()).suffix
    if suffix in (".xlsx", ".xlsm"):
        return next((rows for sheet in xlsx_sheets(content) if (rows := table_rows(sheet))), [])
    if suffix in (".csv", ".txt"):
        return table_rows(csv.reader(io.StringIO(csv_text(content))))
    raise ValueError(f"no reader for files like {name}")


ROW = "file string, source_row int, " + ", ".join(f"{f} string" for f in HEADERS) + ", error string"


def read_spreadsheets(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Rows of all workbooks and CSV files below a path, each file in one task.

    Other files are left out; one that can't be read is a row with nothing but its error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")
    files = files.filter(F.lower("path").rlike(r"\.(xlsx|xlsm|csv|txt)$"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "source_row", *HEADERS, "error"]
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [{"file": path, **r} for r in spreadsheet_rows(path, bytes(content))]
                except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    rows.append({"file": path, "error": f"{type(e).__name__}: {e}"})
            frame = pd.DataFrame(rows, columns=columns).astype({"source_row": "Int32"})
            yield frame.astype(object).where(frame.notna(), None)

    return files.mapInPandas(run, ROW)


# Snapshots and exports ------------------------------------------------------------------------


def source_key(relative_path: str) -> str:
    return f"manual:{PurePosixPath(relative_path.replace(chr(92), '/'))}"


def write_snapshot(records: DataFrame, path: str, source: str) -> None:
    """One JSON document of a source and its records, as a folder of its own."""
    whole = records.agg(F.collect_list(F.struct(*records.columns)).alias("records"))
    whole.select(F.lit(SNAPSHOT).alias("kind"), F.lit(1).alias("version"), F.struct(F.lit(source).alias("image")).alias("source"), "records").write.mode("overwrite").json(path)


def read_snapshots(spark: SparkSession, path: str, record: str) -> DataFrame:
    schema = f"kind string, version int, source struct<image:string>, records array<struct<{record}>>"
    return spark.read.schema(schema).json(path).filter(F.col("kind") == SNAPSHOT).select(F.col("source.image").alias("image"), F.inline("records"))


def static_export(records: DataFrame, listed: Sequence[str], details: Sequence[str]) -> DataFrame:
    """One JSON text for each record: list columns, and detail columns under ``detail``; nulls left out."""
    return records.select(F.to_json(F.struct(*listed, F.struct(*details).alias("detail")), {"ignoreNullFields": "true"}).alias("value"))


# Documents: rules, aliases, configuration -------------------------------------------------------


def load_document(spark: SparkSession, path: str, env: Mapping[str, str] | None = None) -> object:
    """A JSON or YAML document that Spark's readers reach, environment names filled in if ``env`` is given; {} if it is empty."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one document of a person's size
    text = interpolated(text, env) if env is not None else text
    if not text.strip():
        return {}
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text) or {}


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """word: the distinct lines that aren't blank or comments."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter((F.col("word") != "") & ~F.startswith("word", F.lit("#"))).distinct()


class Reloaded:
    """A parsed document that is parsed anew when the file's time or size changes.

    A missing file gives ``default``; while a changed file can't be parsed, the last good state stays
    and ``problem`` says why.
    """

    def __init__(self, spark: SparkSession, path: str, parse: Callable[[object], object], default: object = None):
        self.spark, self.path, self.parse, self.default = spark, path, parse, default
        self.signature: tuple[int, int] | None = None
        self.value, self.problem = default, None

    def _seen(self) -> tuple[int, int] | None:
        file = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = file.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(file):
            return None
        status = system.getFileStatus(file)
        return status.getModificationTime(), status.getLen()

    def get(self) -> object:
        seen = self._seen()
        if seen != self.signature:
            self.signature = seen
            try:
                self.value = self.default if seen is None else self.parse(load_document(self.spark, self.path))
                self.problem = None
            except Exception as e:  # noqa: BLE001 - a person is editing the file
                self.problem = f"{type(e).__name__}: {e}"
        return self.value


def correction_rules(document: object) -> tuple[list[dict], list[dict], list[str]]:
    """Text rules, field rules and warnings of a parsed rule document. Bad entries warn and are left out; images are stems."""
    warnings: list[str] = []
    text_rules: list[dict] = []
    field_rules: list[dict] = []

    def part(owner: object, key: str, kind: type, where: str) -> Any:
        value = owner.get(key) if isinstance(owner, Mapping) else None
        if value is not None and not isinstance(value, kind):
            warnings.append(f"{where} should be a {'list' if kind is list else 'mapping'}")
            value = None
        return value if value is not None else kind() if kind is list else {}

    def text_rule(e: object, image: str | None, where: str) -> None:
        source, target = (e.get("from"), e.get("to")) if isinstance(e, Mapping) else (None, None)
        if not isinstance(source, str) or not source or not isinstance(target, str):
            warnings.append(f"{where}: a rule needs from and to: {e!r}")
            return
        if e.get("regex"):
            try:
                re.compile(source)
            except re.error as bad:
                warnings.append(f"{where}: bad expression {source!r}: {bad}")
                return
        elif source == target:
            warnings.append(f"{where}: {source!r} is replaced by itself")
            return
        text_rules.append({"ord": len(text_rules), "image": image, "from": source, "to": target, "regex": bool(e.get("regex"))})

    def field_rule(e: object, image: str, where: str) -> None:
        if not isinstance(e, Mapping) or (e.get("name") is None and e.get("block_index") is None):
            warnings.append(f"{where}: a rule needs name or block_index: {e!r}")
            return
        values = dict(e["set"]) if isinstance(e.get("set"), Mapping) else {k: v for k, v in e.items() if k not in ("name", "block_index", "set")}
        for name, value in values.items():
            if name not in HEADERS:
                warnings.append(f"{where}: unknown field {name!r}")
                continue
            own = {"image": image, "name": e.get("name"), "block_index": e.get("block_index"), "field": name}
            if any(all(r[k] == v for k, v in own.items()) for r in field_rules):
                warnings.append(f"{where}: {name!r} is set twice; the last rule counts")
            field_rules.append({"ord": len(field_rules), **own, "value": None if value is None else str(value)})

    text = part(document, "text", dict, "text")
    for i, e in enumerate(part(text, "global", list, "text.global")):
        text_rule(e, None, f"text.global[{i}]")
    for kind, add in (("images", text_rule), ("fields", field_rule)):
        owner = part(text, "images", dict, "text.images") if kind == "images" else part(document, "fields", dict, "fields")
        for image in owner:
            where = f"{'text.images' if kind == 'images' else 'fields'}.{image}"
            for i, e in enumerate(part(owner, image, list, where)):
                add(e, image_stem_plain(str(image)), f"{where}[{i}]")
    return text_rules, field_rules, warnings


def rule_table(spark: SparkSession, field_rules: Sequence[Mapping[str, object]]) -> DataFrame:
    """Field rules as a table, for ``jobs.override_records``."""
    columns = ("ord", "image", "name", "block_index", "field", "value")
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in field_rules], "ord int, image string, name string, block_index int, field string, value string")


def alias_table(spark: SparkSession, groups: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    rows = [(i, c, p, t, alias_key(t)) for i, (c, terms) in enumerate(groups) for p, t in enumerate(terms)]
    return spark.createDataFrame(rows, "group_id int, canonical string, pos int, term string, term_norm string")


def interpolated(text: str, env: Mapping[str, str]) -> str:
    """``${NAME}`` and ``${NAME:-default}`` replaced; unknown names without default become ''."""
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m.group(1), m.group(2) or ""), text)


def cookies(text: str) -> dict[str, str]:
    """Cookies as a JSON object, or as a list of objects with name and value."""
    data = json.loads(text)
    return {str(k): str(v) for k, v in data.items()} if isinstance(data, dict) else {str(c["name"]): str(c["value"]) for c in data}


# Network --------------------------------------------------------------------------------------


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """page, notice_id, notice_title of a list's pages saved as page-1.json, page-2.json and so on.

    The list ends before the first page that is absent or empty. Any file system that Spark reads will do.
    """
    raw = spark.read.schema(PAYLOAD).json(f"{path.rstrip('/')}/page-*.json", multiLine=True)
    number = F.regexp_extract(F.input_file_name(), r"page-(\d+)\.json$", 1).cast("int")
    pages = raw.select(number.alias("page"), F.col("datas.tables").alias("rows")).filter(F.size("rows") > 0)
    # Pages that are as many as their number lie before any gap; there is one row for each page here.
    counted = pages.select("page").withColumn("place", F.row_number().over(Window.orderBy("page")))
    whole = counted.filter("page = place").select("page")
    rows = pages.join(whole, "page", "left_semi").select("page", F.explode("rows").alias("r"))
    return rows.select("page", F.col("r.notice_id").alias("notice_id"), F.trim("r.notice_title").alias("notice_title"))


def _opened(url: str, data: bytes | None = None) -> bytes:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, data=data), timeout=30) as answer:  # noqa: S310 - the caller names the scheme
        return answer.read()


class _ListReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.url = options["url"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # whether there is another page only the page before tells

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, seen = 1, 0
        while True:
            answer = json.loads(_opened(self.url.replace("{page}", str(page))))["datas"]
            rows = answer.get("tables") or []
            for row in rows:
                yield page, row.get("notice_id"), (row.get("notice_title") or "").strip()
            seen, page = seen + len(rows), page + 1
            if not rows or seen >= (answer.get("page") or {}).get("total", seen + 1):
                return


class NoticeList(DataSource):
    """A paged list over HTTP: ``url`` holds {page}. It ends at an empty page or at the stated total."""

    @classmethod
    def name(cls) -> str:
        return "notice_list"

    def schema(self) -> str:
        return "page int, notice_id string, notice_title string"

    def reader(self, schema: object) -> DataSourceReader:
        return _ListReader(self.options)


def fetched(rows: DataFrame, url: str = "image_url", opener: Callable[[str], bytes] = _opened) -> DataFrame:
    """``rows`` with content, sha256, size_bytes, status (ok or failed) and error of what ``url`` names. A failure is a row."""
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("content binary, sha256 string, size_bytes long, status string, error string").fields])
    at = rows.columns.index(url)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for address in batch.iloc[:, at]:
                try:
                    content = opener(address)
                    got.append((content, hashlib.sha256(content).hexdigest(), len(content), "ok", None))
                except Exception as e:  # noqa: BLE001 - the next address may do
                    got.append((None, None, None, "failed", f"{type(e).__name__}: {e}"))
            more = pd.DataFrame(got, columns=["content", "sha256", "size_bytes", "status", "error"]).astype({"size_bytes": "Int64"})
            yield pd.concat([batch.reset_index(drop=True), more], axis=1)

    return rows.mapInPandas(run, schema)


# Tables, summaries, static sites ----------------------------------------------------------------


def open_tables(spark: SparkSession, database: str, tables: Mapping[str, str], reset: bool = False) -> list[str]:
    """Creates a database and its Parquet tables (name: schema) where they are missing, and names all; ``reset`` drops them first."""
    if reset:
        spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, schema in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({schema}) USING parquet")
    return sorted(t.name for t in spark.catalog.listTables(database))


def merge_summary(spark: SparkSession, path: str, new: Mapping[str, object]) -> dict:
    """A JSON summary with ``new`` written over its values; other keys stay. The folder holds one document."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = load_document(spark, path) if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file) else {}
    merged = {**(old if isinstance(old, Mapping) else {}), **new}
    spark.createDataFrame([(json.dumps(merged, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return merged


def write_static(records: DataFrame, path: str, listed: Sequence[str], details: Sequence[str], **sections: DataFrame) -> None:
    """What a static site loads: records as JSON lines, and each section (facets, stats, aliases) beside them."""
    static_export(records, listed, details).write.mode("overwrite").text(f"{path}/records")
    for name, section in sections.items():
        section.write.mode("overwrite").json(f"{path}/{name}")


def read_static(spark: SparkSession, path: str, listed: str, details: str) -> DataFrame:
    """Records of a static site with list and detail columns side by side; ``listed`` and ``details`` are schemas."""
    return spark.read.schema(f"{listed}, detail struct<{', '.join(f'{n}:{t}' for n, t in (c.strip().split(' ', 1) for c in details.split(',')))}>").json(f"{path}/records").select("*", "detail.*").drop("detail")
