"""Local files, objects and archives: listing, admission, text extraction."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from email.utils import parsedate_to_datetime
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarnwell.functions import text as T

#: Folders that are never entered, and file endings by kind.
SKIP_DIRS = (".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", "target", "sidecar", ".terraform", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".obsidian", ".trash")
TEXT_EXTENSIONS = (
    "md", "markdown", "rst", "txt", "adoc", "org", "tex", "py", "js", "mjs", "cjs", "ts", "tsx", "jsx", "vue", "svelte", "go", "rs", "java", "kt", "kts", "scala", "clj", "cs", "swift", "m", "mm", "c", "h", "cc", "cpp", "cxx", "hpp", "hxx", "php", "pl",
    "lua", "dart", "groovy", "gradle", "r", "rb", "sh", "bash", "zsh", "ps1", "bat", "yaml", "yml", "json", "toml", "ini", "cfg", "properties", "tf", "tfvars", "hcl", "cmake", "mk", "proto", "sql", "html", "css", "scss", "xml", "csv", "tmpl", "tpl",
)
DOCUMENT_EXTENSIONS = ("pdf", "docx", "pptx", "xlsx", "xlsm")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "heic", "tiff", "webp")
BARE_NAMES = ("dockerfile", "makefile", "readme", "license", "changelog", "contributing")
TEXT_BYTES, DOCUMENT_BYTES = 1_000_000, 25_000_000


def listing(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, mtime, length[, content]) of the files under a path; the content column is read only where it is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    columns = [F.regexp_replace("path", "^file:/+", "/").alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "length"]
    return files.select(*columns, *(["content"] if content else []))


def skip_reason(path: Column, length: Column, root: str = "") -> Column:
    """Why a file is not indexed, null if it is: folder, hidden, kind or size."""
    inner = F.substring(path, len(root) + 1, 1 << 20)
    name = F.element_at(F.split(path, "/"), -1)
    ext = T.extension(path)
    folders = F.slice(F.split(inner, "/"), 1, F.greatest(F.size(F.split(inner, "/")) - 1, F.lit(0)))
    most = F.when(ext.isin(*DOCUMENT_EXTENSIONS, *IMAGE_EXTENSIONS), DOCUMENT_BYTES).otherwise(TEXT_BYTES)
    kind = ext.isin(*TEXT_EXTENSIONS, *DOCUMENT_EXTENSIONS, *IMAGE_EXTENSIONS) | (ext == "") | F.lower(name).isin(*BARE_NAMES)
    return F.when(F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_DIRS))), "folder").when(name.startswith("."), "hidden").when(~kind, "kind").when(length > most, "size")


def admitted(path: Column, length: Column, root: str = "") -> Column:
    """A file may be indexed: outside skipped folders, of a known kind, within the size for its kind, not hidden."""
    return skip_reason(path, length, root).isNull()


def plain_text(data: bytes) -> str | None:
    """Text of bytes, null for binary data."""
    return None if b"\0" in data[:1024] else data.decode("utf-8", "replace")


def _safe_xml(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("document type declarations are refused")
    return ElementTree.fromstring(data)


def _number_in(name: str) -> int:
    return int(re.findall(r"\d+", name)[-1])


def office_text(data: bytes) -> str:
    """Paragraphs of DOCX, slides of PPTX in their order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n == "word/document.xml"] or sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number_in)
        out = []
        for n in names:
            xml = z.read(n).decode("utf-8", "replace")
            xml = re.sub(r"</[wa]:p>", "\n", xml)
            out.append(unescape(re.sub(r"<[^>]+>", "", xml)).strip())
    return "\n\n".join(x for x in out if x)


def sheet_text(data: bytes) -> str:
    """Rows of XLSX as `rN: a | b` under `[sheet] title` and `columns:` with the first row; empty cells and sheets are left out; sheets in numeric order, dates where a cell's format is one."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())

        def local(e: ElementTree.Element) -> str:
            return e.tag.rpartition("}")[2]

        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in _safe_xml(z.read("xl/sharedStrings.xml")) if local(si) == "si"]
        dates = set()
        if "xl/styles.xml" in names:
            root = _safe_xml(z.read("xl/styles.xml"))
            custom = {e.get("numFmtId") for e in root.iter() if local(e) == "numFmt" and re.search(r"[dmyDMY]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", "")))}
            for xfs in (e for e in root.iter() if local(e) == "cellXfs"):
                dates = {k for k, xf in enumerate(xfs) if xf.get("numFmtId") in custom or 14 <= int(xf.get("numFmtId", 0)) <= 22}
        titles = []
        if "xl/workbook.xml" in names:
            titles = [e.get("name") for e in _safe_xml(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
        out = []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number_in)
        for k, n in enumerate(sheets):
            lines: list[str] = []
            for row in (e for e in _safe_xml(z.read(n)).iter() if local(e) == "row"):
                cells = []
                for c in (e for e in row if local(e) == "c"):
                    v = next((e.text or "" for e in c if local(e) == "v"), "")
                    if c.get("t") == "s" and v:
                        v = strings[int(v)]
                    elif c.get("t") == "inlineStr":
                        v = "".join(e.text or "" for e in c.iter() if local(e) == "t")
                    elif v and c.get("t") in (None, "n") and int(c.get("s", 0)) in dates:
                        v = excel_date(float(v))
                    cells.append(v.strip())
                cells = [x for x in cells if x]
                if cells and not lines and len(cells) > 1:
                    lines.append("columns: " + " | ".join(cells))  # said again on top, for chunks that hold later rows only
                if cells:
                    lines.append(f"r{row.get('r', len(lines))}: " + " | ".join(cells))
            if lines:
                out.append("\n".join([f"[sheet] {titles[k] if k < len(titles) else _number_in(n)}", *lines]))
    return "\n\n".join(out)


def excel_date(serial: float) -> str:
    import datetime

    return (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=serial)).date().isoformat()


#: Readers by ending. A PDF or image reader can be registered; without one such files have no text.
READERS: dict[str, Callable[[bytes], str | None]] = {"docx": office_text, "pptx": office_text, "xlsx": sheet_text, "xlsm": sheet_text, **dict.fromkeys((*IMAGE_EXTENSIONS, "pdf"), lambda data: None)}


def read_bytes(path: str, data: bytes) -> str | None:
    """Text of a file; null where it has none or is broken: one bad file never ends a run."""
    ext = path.rpartition("/")[2].rpartition(".")[2].lower()
    try:
        return READERS.get(ext, plain_text)(data)
    except Exception:
        return None


def extracted(files: DataFrame) -> DataFrame:
    """files with `text` from `content`, by file type, in Arrow batches."""

    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, contents in pairs:
            yield pd.Series([read_bytes(p, c) for p, c in zip(paths, contents, strict=True)], dtype=object)

    return files.withColumn("text", F.pandas_udf(run, "string")("path", "content")).drop("content")


def archive_members(files: DataFrame, prefix: str, folder: str = "") -> DataFrame:
    """(path, text) of the text files in tar archives; the top folder is stripped, perhaps only a subfolder is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                    for m in tar:
                        inner = m.name.partition("/")[2]
                        name = inner.rpartition("/")[2]
                        ext = name.rpartition(".")[2].lower() if "." in name[1:] else ""
                        if not m.isfile() or m.size > TEXT_BYTES or folder and not inner.startswith(folder.rstrip("/") + "/") or name.startswith(".") or ext and ext not in TEXT_EXTENSIONS or set(inner.split("/")[:-1]) & set(SKIP_DIRS):
                            continue
                        text = plain_text(tar.extractfile(m).read())
                        if text is not None:
                            rows.append((f"{prefix}/{inner}", text))
                yield pd.DataFrame(rows, columns=["path", "text"])

    return files.select("content").mapInPandas(run, "path string, text string")


def message_parts(data: bytes, most: int | None = None, attachments: int | None = None) -> tuple[str, str, list[tuple[str, str]]]:
    """(subject, text, attachments) of an e-mail: headers and bodies, HTML reduced to text."""
    m = message_from_bytes(data, policy=policy.default)
    heads = [f"{h}: {m[h]}" for h in ("From", "To", "Subject") if m[h]]
    date = mail_date(m["Date"])
    heads += [f"Date: {date}"] if date else []
    bodies, files = [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_filename():
            text = read_bytes(part.get_filename(), part.get_payload(decode=True) or b"")
            if text and (attachments is None or len(files) < attachments):
                files.append((part.get_filename(), text))
        elif part.get_content_type() == "text/plain":
            bodies.append(part.get_content())
        elif part.get_content_type() == "text/html" and not bodies:
            bodies.append(html_text(part.get_content()))
    return str(m["Subject"] or ""), ("\n".join(heads) + "\n\n" + "\n\n".join(b.strip() for b in bodies))[:most], files


def mail_date(value: str | None) -> str:
    try:
        return parsedate_to_datetime(str(value)).date().isoformat() if value else ""
    except (TypeError, ValueError):
        return ""


def html_text(html: str) -> str:
    html = re.sub(rf"(?i)<br\s*/?>|</(?:{T.BLOCK_TAGS})\s*>", "\n", html)
    lines = [x.strip() for x in unescape(re.sub(r"<[^>]+>", "", html)).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def mbox_documents(files: DataFrame, prefix: str = "email") -> DataFrame:
    """(path, title, text): one document per message of mbox files, and one per attachment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                # messages begin at a line "From " after a blank line or at the start; such lines inside a message are quoted with ">"
                for k, raw in enumerate(re.split(rb"(?:\A|(?<=\n\n)|(?<=\r\n\r\n))From [^\n]*\n", data)[1:]):
                    raw = re.sub(rb"(?m)^>(>*From )", rb"\1", raw)
                    subject, text, attached = message_parts(raw)
                    number = message_from_bytes(raw, policy=policy.default)["Message-ID"] or k
                    at = f"{prefix}://{path.rpartition('/')[2]}/{number}"
                    rows.append((at, subject, text))
                    rows += [(f"{at}/{name}", name, body) for name, body in attached]
                yield pd.DataFrame(rows, columns=["path", "title", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, title string, text string")


def obsidian_notes(notes: DataFrame, most: int = 12) -> DataFrame:
    """notes (path, text) with aliases, tags and links of a vault."""
    meta = T.front_matter(F.col("text"))
    lists = lambda k: F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("")), r"[\[\]\"']", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    body = T.without_front_matter(F.col("text"))
    tags = F.slice(F.array_distinct(F.concat(lists("tags"), F.regexp_extract_all(body, F.lit(r"(?U)(?:^|\s)#([\w/-]+)"), F.lit(1)))), 1, most)
    links = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: F.trim(x)))
    return notes.withColumns({"aliases": F.slice(lists("aliases"), 1, most), "tags": tags, "links": links})


def with_aliases(notes: DataFrame) -> DataFrame:
    """Notes (text, aliases) whose text begins with their aliases, so that they are found by them."""
    return notes.withColumn("text", F.when(F.size("aliases") > 0, F.concat(F.lit("Also known as: "), F.array_join("aliases", ", "), F.lit("\n\n"), "text")).otherwise(F.col("text")))


def vaults(listed: DataFrame) -> DataFrame:
    """(root) of the folders in a listing (path) that hold a vault's settings."""
    return listed.select(F.regexp_extract("path", r"^(.*?)/\.obsidian/", 1).alias("root")).filter("root != ''").distinct()


def new_archives(archives: DataFrame, seen: DataFrame) -> DataFrame:
    """Archives (path, content) whose bytes were not taken in before, with their `archive_hash`; seen: path, archive_hash."""
    return archives.withColumn("archive_hash", F.sha2("content", 256)).join(seen.select("path", "archive_hash"), ["path", "archive_hash"], "left_anti")


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries from JSON lines; blank lines are skipped."""
    from skarnwell.schema import GOLDEN

    return spark.read.schema(GOLDEN).json(path).filter("query is not null")
