"""Readers of documents, manifests, chunks, golden sets, label sheets and rank files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import path_key
from tessera.operators.qa import require_unique
from tessera.plans.ship import ship_package

EXTENSIONS = (".txt", ".md", ".html", ".htm", ".pdf", ".docx")

#: Columns of a chunk table and the names by which other tables call them; the first that a table has is taken.
ALIASES = {
    "chunk_id": ("chunk_id", "id"),
    "doc_id": ("doc_id", "document_id"),
    "source": ("source", "source_path", "path"),
    "title": ("title", "doc_title"),
    "url": ("url", "source_url", "doc_url", "document_url"),
    "section_path": ("section_path", "section", "heading"),
    "chunk_text": ("chunk_text", "text", "content"),
}
REQUIRED = ("chunk_id", "doc_id", "source", "title", "section_path", "chunk_text")


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(path, source, extension, doc_id, content) of every file below a folder; doc_id is the content's SHA-1.

    `source` is the path within the folder. With `extensions`, other files are left out before they are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:  # a glob of both cases of every letter, which is tested before a file is opened
        either = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
        files = files.option("pathGlobFilter", "*{" + ",".join(either) + "}")
    files = files.load(folder)
    extension = F.lower(F.regexp_extract("path", r"\.[^./\\]+$", 0))
    root = re.sub(r"^[a-z]+:/*", "/", folder.rstrip("/")) + "/"
    source = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(root), "")
    out = files.withColumn("extension", extension)
    if extensions:
        out = out.filter(F.col("extension").isin([e.lower() for e in extensions]))
    return out.select("path", source.alias("source"), "extension", F.sha1("content").alias("doc_id"), "content")


_REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9A-Fa-f]+;)([A-Za-z][A-Za-z0-9]*;)?")


def closed_references(html: str) -> str:
    """A page in which character references without their semicolon are plain text, as in XML. HTML reads some of the older
    ones, such as `&amp`, without it."""
    return _REFERENCE.sub(lambda m: m.group() if m.group(1) in html5 else "&amp;" + (m.group(1) or ""), html)


class _Text(HTMLParser):
    """The text of a page, piece by piece, without scripts and styles."""

    HIDDEN = {"script", "style", "noscript", "svg"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)


def html_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.pieces)


class _Node:
    """An element of a page's tree: children are elements and strings."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, name: str, attrs: dict, parent: _Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[_Node]:
        """The elements below, in the page's order. By a stack, as pages nest without bound."""
        left = list(reversed(self.children))
        while left:
            c = left.pop()
            if isinstance(c, _Node):
                yield c
                left.extend(reversed(c.children))

    def text(self) -> str:
        """The strings below that are not blank, by single spaces."""
        parts, left = [], list(reversed(self.children))
        while left:
            c = left.pop()
            if isinstance(c, _Node):
                left.extend(reversed(c.children))
            elif c.strip():
                parts.append(c.strip())
        return " ".join(parts)


class _Tree(HTMLParser):
    #: Elements that an element of these names ends, as their end tag may be left out.
    ENDS = {
        **dict.fromkeys(("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "div", "section", "article", "pre", "blockquote", "main", "header", "footer", "nav", "form", "hr"), ("p",)),
        "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    }
    #: An element is not ended from within these.
    HOLDS = {"ul", "ol", "dl", "table", "td", "th", "div", "section", "article", "main", "blockquote", "body", "select", "form"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = self.ENDS.get(tag, ())
        node = self.at
        while ends and node.parent is not None and (node.name in ends or node.name not in self.HOLDS):
            if node.name in ends:
                self.at = node.parent
            node = node.parent
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _Node.VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def html_markdown(html: str, url: str) -> tuple[str, str]:
    """(title, markdown) of a page's main part: its address, headings to the fourth level, paragraphs, list items."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    every = list(tree.root.walk())
    for node in every:
        node.children = [c for c in node.children if not (isinstance(c, _Node) and c.name in _Text.HIDDEN)]
    tests = (lambda n: n.name == "main", lambda n: n.name == "article", lambda n: n.attrs.get("role") == "main", lambda n: n.name == "body")
    alive = list(tree.root.walk())
    main = next((n for test in tests for n in alive if test(n)), tree.root)
    inside = list(main.walk())
    title = next((t for n in inside if n.name == "h1" and (t := n.text())), "") or next((n.text() for n in alive if n.name == "title"), "")
    blocks = [f"Source: {url}" + (f"\n# {title}" if title else "")]
    for n in inside:
        if n.name in ("h1", "h2", "h3", "h4") and (t := n.text()):
            blocks.append("#" * int(n.name[1]) + " " + t)
        elif n.name == "p" and (t := n.text()):
            blocks.append(t)
        elif n.name in ("ul", "ol"):
            items = [f"- {t}" for c in n.children if isinstance(c, _Node) and c.name == "li" and (t := c.text())]
            if items:
                blocks.append("\n".join(items))
    return title, re.sub(r"\n{3,}", "\n\n", "\n\n".join(blocks)).strip() + "\n"


def docx_text(content: bytes) -> str:
    """A Word file's paragraphs that hold text, by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{space}t")).strip() for p in body.iter(f"{space}p"))
    return "\n\n".join(p for p in paragraphs if p)


def pdf_text(content: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pypdf") from e
    return "\n\n".join((page.extract_text() or "").strip() for page in PdfReader(io.BytesIO(content)).pages)


def extract_text(extension: str, content: bytes) -> str:
    if extension in (".txt", ".md"):
        return content.decode("utf-8", errors="ignore")
    if extension in (".html", ".htm"):
        return html_text(content.decode("utf-8", errors="ignore"))
    if extension == ".docx":
        return docx_text(content)
    if extension == ".pdf":
        return pdf_text(content)
    raise ValueError(f"unsupported kind of file: {extension}")


def read_documents(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = EXTENSIONS, skip_bad: bool = False) -> DataFrame:
    """(doc_id, source, text, error) of the files below a folder. A file that can't be read ends the job, or with
    `skip_bad` has a null text and the error."""
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for extension, content in zip(b["extension"], b["content"], strict=True):
                try:
                    texts.append(extract_text(extension, bytes(content)))
                    errors.append(None)
                except Exception as e:
                    if not skip_bad:
                        raise
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "text": texts, "error": errors})

    return discover(spark, folder, extensions).select("doc_id", "source", "extension", "content").mapInPandas(run, "doc_id string, source string, text string, error string")


def read_pages(pages: DataFrame, skip_bad: bool = False, closed: bool = False) -> DataFrame:
    """(page_id, title, text) in markdown from (page_id, url, html). A page that can't be read ends the job, or with
    `skip_bad` has nulls and, in a further column, the error. `closed`: see `closed_references`."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for h, u in zip(b["html"], b["url"], strict=True):
                try:
                    done.append((*html_markdown(closed_references(h or "") if closed else h, u), None))
                except Exception as e:
                    if not skip_bad:
                        raise
                    done.append((None, None, f"{type(e).__name__}: {e}"))
            out = {"page_id": b["page_id"], "title": [t for t, _, _ in done], "text": [m for _, m, _ in done]}
            yield pd.DataFrame(out | ({"error": [e for *_, e in done]} if skip_bad else {}))

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, title string, text string" + (", error string" if skip_bad else ""))


def page_texts(pages: DataFrame, closed: bool = False) -> DataFrame:
    """(page_id, text): all text of (page_id, html), without scripts and styles. `closed`: see `closed_references`."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "text": [html_text(closed_references(h or "") if closed else h or "") for h in b["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


def read_meta(spark: SparkSession, path: str) -> dict:
    """A meta row or JSON object that a writer left, as a dictionary; an empty one if there is none."""
    row = spark.read.option("multiLine", True).json(path).first()
    return row.asDict(recursive=True) if row else {}


def read_config(text: str) -> dict:
    """Configuration in YAML, of which JSON is a part."""
    import yaml

    found = yaml.safe_load(text)
    return found if isinstance(found, dict) else {}


def with_defaults(config: dict, defaults: dict) -> dict:
    """The configuration, with defaults where it lacks a key at any depth."""
    out = dict(defaults)
    for k, v in config.items():
        out[k] = with_defaults(v, out[k]) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_manifest(lines: DataFrame) -> DataFrame:
    """(key, saved_path, source_url, title) from numbered JSON lines (line, value); bad lines are skipped, the last of
    equal paths counts."""
    parsed = lines.select("line", F.from_json("value", "saved_path string, source_url string, title string").alias("m")).select("line", "m.*")
    keyed = parsed.filter("saved_path is not null and trim(saved_path) <> ''").withColumn("key", path_key(F.col("saved_path")))
    last = keyed.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("line")))).filter("r = 1")
    return last.select("key", "saved_path", "source_url", "title")


def reconcile(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, state): found, missing on disk, or not in the manifest."""
    disk = documents.select(path_key(F.col("source")).alias("key")).distinct().withColumn("d", F.lit(1))
    return disk.join(manifest.select("key").distinct().withColumn("m", F.lit(1)), "key", "full_outer").select(
        "key", F.when(F.col("d").isNull(), "missing_on_disk").when(F.col("m").isNull(), "not_in_manifest").otherwise("found").alias("state")
    )


def with_manifest(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents with the manifest's title and url; without one, the title is the file's stem."""
    stem = F.regexp_replace(F.regexp_extract("source", r"[^/\\]+$", 0), r"\.[^.]*$", "")
    joined = documents.drop("title", "url").withColumn("key", path_key(F.col("source"))).join(manifest.select("key", "title", F.col("source_url").alias("url")), "key", "left")
    return joined.withColumn("title", F.coalesce("title", stem)).drop("key")


def with_citations(table: DataFrame) -> DataFrame:
    """A chunk table under its own column names, whatever it calls them; other columns become the map `metadata`.

    Ids must be unique; a required value that is missing is an error; a null url is allowed.
    """
    taken = {name: next((a for a in aliases if a in table.columns), None) for name, aliases in ALIASES.items()}
    missing = [n for n in REQUIRED if taken[n] is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    columns = []
    for name, own in taken.items():
        value = F.col(own).cast("string") if own else F.lit(None).cast("string")
        if name in REQUIRED:
            value = F.coalesce(value, F.raise_error(F.lit(f"{name} is null")).cast("string"))
        columns.append(value.alias(name))
    rest = [c for c in table.columns if c not in taken.values()]
    metadata = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.col(c).cast("string") for c in rest])) if rest else F.create_map().cast("map<string,string>")
    return require_unique(table.select(*columns, metadata.alias("metadata")), "chunk_id")


def read_chunks(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Chunks from Parquet; only the wanted columns are read."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def checked_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, embedding as floats) with one dimension and unique ids, or an error."""
    ok = F.when(F.size("embedding") != dim, F.raise_error(F.concat(F.lit("wrong dimension: "), F.col("chunk_id").cast("string"))).cast("boolean")).otherwise(True)
    return require_unique(vectors.filter(ok).select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")), "chunk_id")


def read_golden(spark: SparkSession, path: str, bucket: str | None = None) -> DataFrame:
    """(qid, query, best_chunk, chunk_ids) from a golden set in JSON."""
    schema = "qid string, bucket string, query string, best_chunk struct<row_index:int,chunk_id:string>, chunk_ids array<struct<row_index:int,chunk_id:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = rows.filter(F.col("bucket") == bucket) if bucket else rows
    return rows.select("qid", "query", F.col("best_chunk.chunk_id").alias("best_chunk"), F.transform("chunk_ids", lambda c: c["chunk_id"]).alias("chunk_ids"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("qid string, query string").json(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("qid string, query string, pool array<struct<chunk_id:string,dense_score:double,bm25_score:double,hybrid_score:double>>").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="qid string, query string, candidate_rank int, chunk_id string, label int, is_best int")


def read_ranks(lines: DataFrame) -> DataFrame:
    """(qid, at, rank) from numbered lines (line, value) such as `q1 : 3,1`; what is no number is dropped, the last line
    of a query counts."""
    parts = lines.filter(F.col("value").contains(":")).select("line", F.trim(F.split_part("value", F.lit(":"), F.lit(1))).alias("qid"), F.substring_index("value", ":", -1).alias("list"))
    last = parts.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("line")))).filter("r = 1")
    ranks = F.filter(F.transform(F.split("list", ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$"))
    return last.select("qid", F.posexplode(ranks).alias("at", "rank")).select("qid", "at", F.col("rank").cast("int").alias("rank"))
