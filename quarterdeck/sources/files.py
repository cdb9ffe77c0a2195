"""File sources and sinks."""

from __future__ import annotations

import io
import os
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from urllib.request import urlopen
from xml.etree import ElementTree

import pandas as pd

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the files.
BOND_FIELDS = ("mid_price", "bid", "ask", "yldtomat", "bmk_spd", "mod_durtn", "convexity", "clean_prc", "dirty_prc", "zspread", "int_cds")
MACRO_SCHEMA = "country string, series string, period_date date, available_date date, value double, source string"
ISSUE_SCHEMA = "reason string, entity string, item string"
RATING_COLUMNS = ("date", "agency", "rating", "outlook", "action", "source")


def load_yaml(path: str) -> dict:
    """A parameter file, on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


_ENTITY = ("name", "iso2", "iso3", "classification", "bond_ric", "cds_ric")


def universe_yaml(spark: SparkSession, path: str) -> DataFrame:
    """The entities of one or many YAML files, read where they lie: lists of mappings with an ``iso3``, with the list's name as ``listing``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                config = yaml.load(text, loader) or {}
                lists = config.items() if isinstance(config, dict) else [("entities", config)]
                rows += [(*(None if e.get(n) is None else str(e[n]) for n in _ENTITY), key) for key, entries in lists if isinstance(entries, list) for e in entries if isinstance(e, dict) and "iso3" in e]
            yield pd.DataFrame(rows, columns=[*_ENTITY, "listing"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, ", ".join(f"{n} string" for n in (*_ENTITY, "listing")))


def write_universe_yaml(entities: DataFrame, path: str, listing: str = "core") -> None:
    """Entities as YAML files, a flow mapping to a line, each file a list named ``listing``."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = [f"{listing}:"]
        for pdf in batches:
            yield pd.DataFrame({"value": head + ["- " + v for v in pdf["value"]]})
            head = []

    entities.select(F.to_json(F.struct(*(F.col(n).cast("string").alias(n) for n in _ENTITY))).alias("value")).mapInPandas(lines, "value string").write.text(path)


def universe_frame(spark: SparkSession, config: dict) -> DataFrame:
    """The entities of a configuration, from its lists of mappings, with the list's name as ``listing``."""
    rows = [(*(str(e[n]) if e.get(n) is not None else None for n in _ENTITY), key) for key, entries in config.items() if isinstance(entries, list) for e in entries if isinstance(e, dict) and "iso3" in e]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in (*_ENTITY, "listing")]))


def entity_of_file() -> F.Column:
    """The entity that a file is about, with blanks for underscores: its folder's ``entity=`` part, or else its own stem."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/entity=([^/]+)/[^/]*$", 1)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[A-Za-z]+$", 1)
    return F.translate(F.url_decode(F.coalesce(F.nullif(folder, F.lit("")), stem)), "_", " ")


def write_entity_csvs(df: DataFrame, entity: str, path: str, rows_per_file: int = 1_000_000) -> None:
    """A folder per entity (``entity=<name>``) with its CSV files, each with a header; an entity of very many rows is several files.

    Rows are spread by entity and a hash of the row, in as many shares as the largest entity needs, so no writer gets a hot entity alone.
    """
    largest = df.groupBy(entity).count().agg(F.max("count")).first()[0] or 1
    rest = [c for c in df.columns if c != entity]
    share = F.pmod(F.xxhash64(*rest), F.lit(-(-largest // rows_per_file)))
    named = df.withColumn("entity", F.translate(entity, " ", "_")).select("entity", *rest)
    named.repartition("entity", share).write.partitionBy("entity").option("maxRecordsPerFile", rows_per_file).option("header", True).csv(path)


def _headers(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Files of a folder, and of the folders in it, by their first line. Names that begin with ``_`` or a dot are skipped; of a file only the beginning is read."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out: dict[str, list[str]] = {}
    pending = [root]
    while pending:
        at = pending.pop()
        if not system.exists(at):
            continue
        for status in system.listStatus(at):
            path, name = status.getPath(), status.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if status.isDirectory():
                pending.append(path)
            elif name.endswith(".csv") and status.getLen() > 0:
                stream = system.open(path)
                reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
                try:
                    out.setdefault((reader.readLine() or "").strip(), []).append(path.toString())
                finally:
                    reader.close()
    return out


def entity_csvs(spark: SparkSession, folder: str, fields=BOND_FIELDS) -> DataFrame:
    """Every entity's daily CSVs of a folder as one long table; columns that a file lacks are NULL.

    Files have different columns, so they are matched by header name (a positional schema would misalign): a listing reads
    every file's first line, then the files of one header are one scan. Files named ``_*`` are skipped; an
    absent or empty file is absent rows.
    """
    out = None
    for head, paths in sorted(_headers(spark, folder).items()):
        names = [c.strip().lower() for c in head.split(",")]
        schema = T.StructType([T.StructField(c, T.DateType() if c == "date" else T.DoubleType() if c in fields else T.StringType()) for c in names])
        part = spark.read.schema(schema).option("header", True).csv(paths).withColumn("entity", entity_of_file())
        cols = ["entity", "date", *fields]
        part = part.select(*(F.col(c) if c in [*names, "entity"] else F.lit(None).cast("double").alias(c) for c in cols))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "entity string, date date, " + ", ".join(f"{f} double" for f in fields))
    return out


def macro_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MACRO_SCHEMA).option("header", True).csv(path)


def ratings_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All rating files of a folder, the country from the file's name; files named ``_*`` are skipped."""
    schema = ", ".join(f"{c} {'date' if c == 'date' else 'string'}" for c in RATING_COLUMNS)
    read = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
    return read.csv(folder, pathGlobFilter="*.csv").withColumn("country", entity_of_file())


def two_sources(spark: SparkSession, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """The two rating sheets, as CSV or Parquet files; required columns are checked."""
    return tuple(_checked(spark.read.parquet(p) if p.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(p), p) for p in (first, second))


def _checked(df: DataFrame, where: str) -> DataFrame:
    if lacking := {"agency", "rating", "outlook", "date", "source"} - set(df.columns):
        raise ValueError(f"{where}: missing required columns {sorted(lacking)}")
    return df.withColumn("date", F.to_date("date"))


#: Rows of a workbook that is written here.
BOOK_ROWS = 200_000

# Names in the spreadsheet format.
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_EPOCH = pd.Timestamp("1899-12-30")


def read_sheet(book: bytes, sheet: str) -> list[dict[str, str | None]]:
    """Rows of one sheet of a workbook (.xlsx) as mappings from the header; cells are texts, numbers in a column named ``date`` are days."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): target[s.get(_REL)] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")}
        if sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}, only {sorted(sheets)}")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in i.iter(f"{_SHEET}t")) for i in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        path = sheets[sheet].lstrip("/")
        tree = ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
    rows: list[dict[int, str | None]] = []
    for row in tree.iter(f"{_SHEET}row"):
        cells = {}
        for n, c in enumerate(row.iter(f"{_SHEET}c")):
            letters = re.match(r"[A-Z]+", c.get("r") or "")
            at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else n
            v, kind = c.find(f"{_SHEET}v"), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if kind == "inlineStr" else None if v is None else v.text
            cells[at] = shared[int(text)] if kind == "s" and text is not None else text
        rows.append(cells)
    names = {at: (name or "").strip().lower() for at, name in (rows[0] if rows else {}).items()}
    out = []
    for cells in rows[1:]:
        r = {name: cells.get(at) for at, name in names.items()}
        if r.get("date") and re.fullmatch(r"\d+(\.\d+)?", r["date"]):
            r["date"] = str((_EPOCH + pd.Timedelta(days=float(r["date"]))).date())
        out.append(r)
    return out


def write_workbook(sheets: dict[str, pd.DataFrame]) -> bytes:
    """A plain workbook (.xlsx) with every cell as text."""

    def cell(v) -> str:
        text = "" if v is None or v != v else str(v)
        return f'<c t="inlineStr"><is><t xml:space="preserve">{text.replace("&", "&amp;").replace("<", "&lt;")}</t></is></c>' if text else "<c/>"

    out, main = io.BytesIO(), _SHEET[1:-1]
    office = _REL[1:].rsplit("}", 1)[0]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        types = "http://schemas.openxmlformats.org/package/2006/content-types"
        z.writestr("[Content_Types].xml", f'<Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        for i, df in enumerate(sheets.values()):
            lines = [list(df.columns), *df.itertuples(index=False)]
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, line)) + "</row>" for line in lines) + "</sheetData></worksheet>")
    return out.getvalue()


def workbook_sheets(spark: SparkSession, path: str, first: str = "GE", second: str = "CE") -> tuple[DataFrame, DataFrame]:
    """The two rating sheets of the workbooks of a folder (or of one), a workbook to a task; the country is the file's name up to a tilde. Required columns are checked."""
    columns = ("agency", "rating", "outlook", "date", "source")
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)

    def sheet(name: str) -> DataFrame:
        def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for file, content in zip(pdf["path"], pdf["content"]):
                    rows = read_sheet(content, name)
                    if rows and (lacking := set(columns) - set(rows[0])):
                        raise ValueError(f"{file}, {name}: missing required columns {sorted(lacking)}")
                    stem = os.path.basename(file).rsplit(".", 1)[0].rsplit("~", 1)[0].replace("_", " ")
                    yield pd.DataFrame({"country": pd.Series([stem] * len(rows), dtype=object), **{c: pd.Series([r[c] for r in rows], dtype=object) for c in columns}})

        text = books.select("path", "content").mapInPandas(parse, "country string, " + ", ".join(f"{c} string" for c in columns))
        return text.withColumn("date", F.to_date("date"))

    return sheet(first), sheet(second)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with that schema, or an empty frame where there is no such file."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def with_retries(call: Callable, attempts: int = 3, pause: float = 2.0, sleep=time.sleep):
    """The result of a call that may fail, tried again after ``pause`` times the attempt's number."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if attempt == attempts:
                raise
            sleep(pause * attempt)


def fetch_url(url: str) -> str:
    """The text behind a URL (http, https or file)."""
    with urlopen(url, timeout=60) as response:  # noqa: S310
        return response.read().decode("utf-8")


def cached_payload(path: str, fetch: Callable[[], str], refresh: bool = False) -> str:
    """A text payload kept in a file of the driver; fetched when absent or to be refreshed."""
    if refresh or not os.path.exists(path):
        text = with_retries(fetch)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    with open(path, encoding="utf-8") as f:
        return f.read()


def cached_payloads(requests: DataFrame, path: str, fetch: Callable[[str], str] = fetch_url, refresh: bool = False, pause: float = 2.0) -> DataFrame:
    """``requests`` (with a ``url``) and ``payload``: every URL's text, from a cache table at ``path``, fetched by the executors where it lacks.

    A fetch is tried three times with growing pauses. The cache is appended to; the payload fetched last counts. ``refresh`` fetches all anew.
    """
    spark = requests.sparkSession
    schema = "url string, payload string, fetched_at timestamp"
    wanted = requests.select("url").filter("url IS NOT NULL").distinct()
    try:
        known = spark.read.schema(schema).parquet(path)
        missing = wanted if refresh else wanted.join(known.select("url"), "url", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = wanted

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url in pdf["url"]:
                yield pd.DataFrame({"url": [url], "payload": [with_retries(lambda: fetch(url), pause=pause)], "fetched_at": [pd.Timestamp.now()]})  # noqa: B023

    missing.mapInPandas(get, schema).write.mode("append").parquet(path)
    latest = spark.read.schema(schema).parquet(path).groupBy("url").agg(F.max_by("payload", "fetched_at").alias("payload"))
    return requests.join(latest, "url", "left")


_WB = "array<struct<countryiso3code:string, date:string, value:double>>"


def flatten_world_bank(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``iso3, year, value`` of payloads ``[meta, rows]``; rows without a value are dropped."""
    rows = F.from_json(F.get_json_object(F.col(payload), "$[1]"), _WB)
    flat = payloads.select(*[c for c in payloads.columns if c != payload], F.explode(rows).alias("r"))
    return flat.select(*[c for c in payloads.columns if c != payload], F.col("r.countryiso3code").alias("iso3"), F.col("r.date").cast("int").alias("year"), F.col("r.value").alias("value")).filter("value IS NOT NULL")


def flatten_weo(payloads: DataFrame, payload: str = "payload", indicator: str = "indicator", first: int = 2005, last: int = 2025) -> DataFrame:
    """``indicator, iso3, year, value`` of payloads ``{"values": {indicator: {iso3: {year: value}}}}``; years are digits within the range."""
    nested = F.from_json(F.get_json_object(F.col(payload), "$.values"), "map<string, map<string, map<string, double>>>")
    by_code = payloads.select(F.explode(nested).alias(indicator, "codes")).select(indicator, F.explode("codes").alias("iso3", "years"))
    flat = by_code.select(indicator, "iso3", F.explode("years").alias("y", "value"))
    return flat.filter(F.col("y").rlike("^[0-9]+$")).withColumn("year", F.col("y").cast("int")).filter(F.col("year").between(first, last) & F.col("value").isNotNull()).select(indicator, "iso3", "year", "value")


def fred_series(raw: DataFrame, first: str, last: str, lag_days: int) -> DataFrame:
    """``date, value, available_date`` of rows of text: within the range, numeric values only, known ``lag_days`` later."""
    rows = raw.select(F.to_date("date").alias("date"), F.col("value").try_cast("double").alias("value"))
    return rows.withColumn("available_date", F.date_add("date", lag_days)).filter(F.col("date").between(first, last) & F.col("value").isNotNull())


def date_chunks(spark: SparkSession, first: str, last: str, years: int = 2) -> DataFrame:
    """``chunk_start, chunk_end``: consecutive ranges of so many years that cover two dates."""
    starts = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"interval {years} years"))
    return spark.range(1).select(F.explode(starts).alias("chunk_start")).select(
        "chunk_start", F.least(F.date_sub(F.add_months("chunk_start", 12 * years), 1), F.lit(last).cast("date")).alias("chunk_end")
    )


def flattened(history: DataFrame) -> DataFrame:
    """A wide history, ``date`` and one column per (field, instrument) named ``<field>|<instrument>``, as long rows: ``date, instrument`` and a column per field.

    An instrument's cells that are all NULL on a date give no row.
    """
    pairs = [(c, *c.split("|", 1)) for c in history.columns if "|" in c]
    fields = list(dict.fromkeys(f for _, f, _ in pairs))
    by_instrument: dict[str, dict[str, str]] = {}
    for c, f, i in pairs:
        by_instrument.setdefault(i, {})[f] = c
    rows = [F.struct(F.lit(i).alias("instrument"), *((F.col(f"`{cs[f]}`") if f in cs else F.lit(None).cast("double")).alias(f) for f in fields)) for i, cs in by_instrument.items()]
    long = history.select("date", F.explode(F.array(*rows)).alias("r")).select("date", "r.*")
    return long.filter(F.coalesce(*fields).isNotNull()) if fields else long


def concatenated(chunks: list[DataFrame], keys: list[str]) -> DataFrame:
    """Chunks of a history one after another, by name with NULL for columns that a chunk lacks; of a key in several chunks the first one's row stays."""
    out = None
    for i, chunk in enumerate(chunks):
        part = chunk.withColumn("_chunk", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (*keys, "_chunk")]
    return out.groupBy(*keys).agg(*(F.min_by(c, "_chunk").alias(c) for c in rest))


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_binaries(df: DataFrame, name: str, content: str, path: str) -> None:
    """One file per row in a folder, named by the row: through the file system of Spark's own Hadoop configuration where it is local, by the executors."""
    local = path.removeprefix("file://")
    if "://" in local:
        raise ValueError("single files are written to file: paths only")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(local, exist_ok=True)
        for pdf in batches:
            for n, c in zip(pdf["name"], pdf["content"]):
                with open(os.path.join(local, n), "wb") as f:
                    f.write(c)
            yield pd.DataFrame({"n": [len(pdf)]})

    df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(put, "n int").agg(F.sum("n")).collect()


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> DataFrame:
    """CSV with a header; ``one_file`` for small reports that must be a single file."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Written only where nothing has been written yet; what is there is returned."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def log_issues(issues: DataFrame, path: str) -> DataFrame:
    """Issues appended to a pipe-delimited log; the whole log is returned."""
    issues.select("reason", "entity", "item").write.mode("append").option("sep", "|").csv(path)
    return issues.sparkSession.read.schema(ISSUE_SCHEMA).option("sep", "|").csv(path)


def safe_name(entity: str) -> str:
    """File name of an entity."""
    return re.sub(r"\s+", "_", entity.strip())
