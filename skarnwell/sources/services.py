"""What services return, as rows: the half of a connector that needs no network. Payloads come as JSON strings in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarnwell.durable import checkpointed
from skarnwell.functions import text as T

_RICH = "array<struct<plain_text:string>>"
_BODY = f"struct<rich_text:{_RICH},title:string,checked:boolean,language:string,cells:array<{_RICH}>>"
#: Block types of a page that carry text, and the sign each line begins with.
_MARKS = {"paragraph": "", "callout": "", "toggle": "", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> ", "heading_1": "\n# ", "heading_2": "\n## ", "heading_3": "\n### "}
#: What documents of an office suite are exported as, and other types taken as they are.
EXPORTS = {"application/vnd.google-apps.document": "text/plain", "application/vnd.google-apps.spreadsheet": "text/csv", "application/vnd.google-apps.presentation": "text/plain"}
TEXT_TYPES = ("text/", "application/json", "application/xml")


def notion_blocks(payloads: DataFrame, page: str, payload: str) -> DataFrame:
    """(page, id, parent, pos, type, has_children, text) of the blocks in the responses of a page's children, in order; text is empty for types without.

    payloads: page, parent (the block whose children these are; the page itself at the top), a number of the response, and the response.
    """
    kinds = [*_MARKS, "to_do", "code", "table_row", "child_page"]
    schema = "struct<results:array<struct<id:string,type:string,has_children:boolean," + ",".join(f"{k}:{_BODY}" for k in kinds) + ">>>"
    rows = payloads.select(page, "parent", "response", F.posexplode(F.from_json(payload, schema)["results"]).alias("at", "b"))
    joined = lambda rich: F.array_join(F.transform(F.coalesce(rich, F.array().cast(_RICH)), lambda x: F.coalesce(x["plain_text"], F.lit(""))), "")
    text = F.lit("")
    for kind, mark in _MARKS.items():
        own = joined(F.col(f"b.{kind}.rich_text"))
        text = F.when((F.col("b.type") == kind) & (F.trim(own) != ""), F.concat(F.lit(mark), own, F.lit("\n" if mark.startswith("\n") else ""))).otherwise(text)
    todo, code = joined(F.col("b.to_do.rich_text")), joined(F.col("b.code.rich_text"))
    text = F.when((F.col("b.type") == "to_do") & (F.trim(todo) != ""), F.concat(F.when(F.col("b.to_do.checked"), "[x] ").otherwise("[ ] "), todo)).otherwise(text)
    text = F.when((F.col("b.type") == "code") & (F.trim(code) != ""), F.concat(F.lit("```"), F.coalesce("b.code.language", F.lit("")), F.lit("\n"), code, F.lit("\n```"))).otherwise(text)
    text = F.when(F.col("b.type") == "table_row", F.array_join(F.transform(F.col("b.table_row.cells"), joined), " | ")).otherwise(text)
    text = F.when(F.col("b.type") == "child_page", F.concat(F.lit("\n# "), F.coalesce("b.child_page.title", F.lit("untitled")), F.lit("\n"))).otherwise(text)
    return rows.select(page, F.col("b.id").alias("id"), "parent", F.struct("response", "at").alias("pos"), F.col("b.type").alias("type"), F.coalesce("b.has_children", F.lit(False)).alias("has_children"), text.alias("text"))


def notion_pages(blocks: DataFrame, page: str, depth: int = 20) -> DataFrame:
    """(page, text): the texts of a page's blocks, level by level as they are fetched; what lies in child pages is left to these."""
    level = blocks.filter(F.col("parent") == F.col(page)).withColumn("level", F.lit(0))
    every = level
    for n in range(1, depth):
        up = level.filter("has_children and type != 'child_page'").select(page, F.col("id").alias("parent"))
        level = checkpointed(blocks.join(up, [page, "parent"]).withColumn("level", F.lit(n)))
        if level.isEmpty():
            break
        every = every.unionByName(level)
    shown = every.filter("text != ''").groupBy(page).agg(F.sort_array(F.collect_list(F.struct("level", "parent", "pos", "text"))).alias("t"))
    return shown.select(page, F.btrim(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), F.lit(" \n")).alias("text"))


def notes_dump(dumps: DataFrame, dump: str, separator: str) -> DataFrame:
    """(title, text) of the notes in exported dumps: after each separator a title line, then HTML. Notes without text are left out; a title has 200 characters at most."""
    note = dumps.select(F.posexplode(F.split(F.col(dump), T.literal_regex(separator))).alias("at", "note")).filter("at > 0").select(F.btrim("note", F.lit(" \n\r\t")).alias("note")).filter("note != ''")
    title = F.trim(F.substring_index("note", "\n", 1))
    rows = note.select(F.substring(F.when(title == "", "untitled note").otherwise(title), 1, 200).alias("title"), T.html_to_text(F.regexp_replace("note", r"\A[^\n]*\n?", "")).alias("text"))
    return rows.filter("text != ''")


def drive_items(payloads: DataFrame, folder: str, payload: str) -> DataFrame:
    """(folder, id, name, is_folder, modified, size, url): items of the responses to a folder's listing; what is neither file nor folder is left out."""
    schema = "struct<value:array<struct<id:string,name:string,folder:struct<childCount:int>,file:struct<mimeType:string>,lastModifiedDateTime:timestamp,size:long,`@microsoft.graph.downloadUrl`:string>>>"
    rows = payloads.select(F.col(folder).alias("folder"), F.explode(F.from_json(payload, schema)["value"]).alias("i")).filter("i.folder is not null or i.file is not null")
    return rows.select("folder", "i.id", "i.name", F.col("i.folder").isNotNull().alias("is_folder"), F.col("i.lastModifiedDateTime").alias("modified"), "i.size", F.col("i.`@microsoft.graph.downloadUrl`").alias("url"))


def walk(items: DataFrame, root: str, most_items: int = 2000, most_folders: int = 200, depth: int = 50) -> DataFrame:
    """(path, id, modified, size, url): files under a root folder, breadth first: one join of the frontier per level. The limits are those of a sync job."""
    spark = items.sparkSession
    frontier = spark.createDataFrame([(root, "")], "folder string, prefix string")
    found, folders = None, 0
    for level in range(depth):
        inside = checkpointed(items.join(frontier, "folder").withColumn("path", F.concat("prefix", F.lit("/"), "name")).withColumn("level", F.lit(level)))
        files = inside.filter("not is_folder").select("level", F.substring("path", 2, 1 << 20).alias("path"), "id", "modified", "size", "url")
        found = files if found is None else found.unionByName(files)
        left = most_folders - folders - 1
        frontier = inside.filter("is_folder").orderBy("path").limit(max(left, 0)).select(F.col("id").alias("folder"), F.col("path").alias("prefix"))
        n = frontier.count()
        folders += n
        if not n:
            break
    return found.orderBy("level", "path").limit(most_items).drop("level")


def confluence_pages(payloads: DataFrame, payload: str, base: str) -> DataFrame:
    """(path, title, text, version) of the pages in search responses; bodies are storage HTML."""
    schema = "struct<results:array<struct<id:string,title:string,space:struct<key:string>,version:struct<when:timestamp>,body:struct<storage:struct<value:string>>>>>"
    r = payloads.select(F.explode(F.from_json(payload, schema)["results"]).alias("p"))
    path = F.concat(F.lit(base.rstrip("/") + "/"), F.coalesce("p.space.key", F.lit("unknown")), F.lit("/"), "p.id")
    return r.select(path.alias("path"), F.col("p.title").alias("title"), F.concat(F.lit("# "), "p.title", F.lit("\n\n"), T.html_to_text(F.coalesce("p.body.storage.value", F.lit("")))).alias("text"), F.col("p.version.when").alias("version"))


def next_link(payload: Column) -> Column:
    """Where the next page of a listing is, null after the last: `_links.next`, `@odata.nextLink`, `next_cursor` or `nextPageToken`."""
    j = F.from_json(payload, "struct<_links:struct<next:string>,`@odata.nextLink`:string,next_cursor:string,has_more:boolean,nextPageToken:string>")
    return F.coalesce(j["_links"]["next"], j["@odata.nextLink"], F.when(j["has_more"], j["next_cursor"]), j["nextPageToken"])


def export_type(mime: Column) -> Column:
    """How a file of a drive is fetched: the type it is exported as, its own if it is text, null if it is left out."""
    out = F.lit(None).cast("string")
    for prefix in TEXT_TYPES:
        out = F.when(mime.startswith(prefix), mime).otherwise(out)
    for kind, to in EXPORTS.items():
        out = F.when(mime == kind, to).otherwise(out)
    return out


def newest_messages(mails: DataFrame, date: str, most: int) -> DataFrame:
    """The newest messages of a mailbox."""
    return mails.orderBy(F.desc_nulls_last(date)).limit(most)
