import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from skarnwell import ingest
from skarnwell.files import Folder
from skarnwell.operators.embed import HashingEmbedder
from skarnwell.sources import files, registry, web
from skarnwell.store import Catalog, EmbedderMismatch, classify, missing_local
from skarnwell.streaming import watch


def put(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.md").write_text(text)


def test_incremental_index(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / ".git").mkdir()
    put(src / ".git", hidden="no")
    put(src, a="---\nstatus: draft\n---\nalpha " * 3, b="beta")
    (src / "c.bin").write_bytes(b"\0\1")
    cat, e = Catalog(spark, str(tmp_path / "cat")), HashingEmbedder(16)
    assert watch.sync(spark, str(src), cat, e) == {"new": 2}
    assert watch.sync(spark, str(src), cat, e) == {"unchanged": 2}
    assert cat.table("chunks").count() == 2 and cat.table("chunks").filter("size(embedding) = 16").count() == 2
    put(src, b="changed", d="delta")
    (src / "a.md").unlink()
    assert watch.sync(spark, str(src), cat, e) == {"new": 1, "changed": 1, "missing": 1}
    assert sorted(r.path.rsplit("/")[-1] for r in cat.table("documents").collect()) == ["b.md", "d.md"]
    assert {r.text for r in cat.table("chunks").collect()} == {"changed", "delta"}
    with pytest.raises(EmbedderMismatch):
        cat.ensure_embedder("other", 16)


def test_watch_stream_is_idempotent(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    put(src, a="alpha", b="beta")
    cat, e = Catalog(spark, str(tmp_path / "cat")), HashingEmbedder(8)
    for k in range(2):
        watch.watch(spark, str(src), cat, e, str(tmp_path / f"check{k}")).awaitTermination()
        assert cat.table("documents").count() == 2
    put(src, c="gamma")
    watch.watch(spark, str(src), cat, e, str(tmp_path / "check1")).awaitTermination()
    assert cat.table("documents").count() == 3


def test_backup_restore_export(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    one = spark.createDataFrame([(1, "t")], "id long, title string").withColumns({"created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})
    cat.commit({"chats": one})
    name = cat.backup()
    cat.commit({"chats": one.union(one)})
    assert cat.table("chats").count() == 2
    cat.restore(name)
    assert cat.table("chats").count() == 1
    cat.export_bundle(str(tmp_path / "bundle"))
    other = Catalog(spark, str(tmp_path / "other"))
    other.import_bundle(str(tmp_path / "bundle"))
    assert other.table("chats").count() == 1 and other.table("memories").count() == 0
    assert cat.vacuum() == []
    for b in (tmp_path / "cat").glob("BACKUP-*"):
        b.unlink()
    assert len(cat.vacuum()) == 1
    with pytest.raises(FileExistsError):
        cat.export_bundle(str(tmp_path / "bundle"))
    bundle = Folder(spark, str(tmp_path / "bundle"))
    bundle.write("CURRENT", bundle.read("CURRENT").replace('"2.0"', '"2.7"'))
    other.import_bundle(str(tmp_path / "bundle"))
    bundle.write("CURRENT", bundle.read("CURRENT").replace('"2.7"', '"3.0"'))
    with pytest.raises(ValueError):
        other.import_bundle(str(tmp_path / "bundle"))


def test_updates_write_only_their_buckets(spark, tmp_path):
    cat, e = Catalog(spark, str(tmp_path / "cat")), HashingEmbedder(8)
    many = spark.createDataFrame([(f"p{k}", f"text {k}", 1.0) for k in range(100)], "path string, text string, mtime double")
    assert ingest.index(cat, many, "s", e) == {"new": 100}
    before = cat.manifest["tables"]["chunks"]
    assert ingest.index_one(cat, "p7", "other", 2.0, "s", e)["changed"] == 1
    after = cat.manifest["tables"]["chunks"]
    assert len(before) > 20 and sum(before[k] != after[k] for k in before) == 1 and before.keys() == after.keys()
    assert ingest.index_one(cat, "p7", "third", 2.0, "t", e) == {"new": 1}  # the same path in another source
    assert sorted(r.text for r in cat.table("chunks").filter("text not like 'text %'").collect()) == ["other", "third"] and cat.table("documents").count() == 101
    assert ingest.index_one(cat, "p7", "other", 3.0, "s", e)["touched"] == 1
    assert {(r.source, r.mtime) for r in cat.table("documents").filter("path = 'p7'").collect()} == {("s", 3.0), ("t", 2.0)}
    gone = cat.vacuum()
    assert gone and cat.table("chunks").count() == 101
    s = spark.createDataFrame([("/r/a.md", 1, "x"), ("/r/b.md", 1, None), ("/r/c.bin", 1, None)], "path string, length long, text string")
    assert {r.path: r.reason for r in ingest.skipped(s).collect()} == {"/r/b.md": "no text", "/r/c.bin": "kind"}


def test_classify_and_missing(spark):
    d = spark.createDataFrame([("a", 1.0, "h", "c"), ("b", 1.0, "h", "c"), ("d", None, None, None), ("g", 1.0, "h", "c")], "path string, mtime double, content_hash string, chunk_config string")
    f = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "h"), ("d", 1.0, "h"), ("n", 1.0, "h")], "path string, mtime double, content_hash string")
    assert {r.path: r.state for r in classify(d, f, "c").collect()} == {"a": "unchanged", "b": "touched", "d": "changed", "g": "missing", "n": "new"}
    docs = spark.createDataFrame([("/r/a", "local"), ("/r2/a", "local"), ("/r/b", "web")], "path string, source string")
    assert [r.path for r in missing_local(docs, docs.limit(0), ["/r", "relative"]).collect()] == ["/r/a"]


def test_archive_office_mail(spark, tmp_path):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        for name, data in (("top/docs/a.md", b"hello"), ("top/node_modules/x.md", b"no"), ("top/docs/b.bin", b"\0")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "r.tar.gz").write_bytes(buffer.getvalue())
    got = registry.run_job(spark, "archive", {"path": str(tmp_path / "r.tar.gz"), "prefix": "github://o/r"}).collect()
    assert [(r.path, r.text) for r in got] == [("github://o/r/docs/a.md", "hello")]
    assert len(registry.job_id("local", {"b": 1, "a": 2})) == 12
    with pytest.raises(ValueError):
        registry.run_job(spark, "nothing", {})

    def office(**parts):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, x in parts.items():
                z.writestr(n, x)
        return b.getvalue()

    assert files.office_text(office(**{"word/document.xml": "<w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>Three</w:t></w:p>"})) == "One & two\nThree"
    sheet = '<worksheet><sheetData><row r="2"><c t="s"><v>0</v></c><c s="1"><v>45000</v></c><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'
    book = office(**{
        "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
        "xl/styles.xml": '<styleSheet><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/workbook.xml": '<workbook><sheets><sheet name="Plan"/></sheets></workbook>',
    })
    assert files.sheet_text(book) == "[sheet] Plan\ncolumns: name | 2023-03-15 | x\nr2: name | 2023-03-15 | x"
    assert files.read_bytes("x.xlsx", office(**{"xl/worksheets/sheet1.xml": "<!DOCTYPE x><worksheet/>"})) is None
    assert files.read_bytes("x.pdf", b"%PDF") is None and files.read_bytes("x.txt", b"\xff ok") == "� ok"
    box = b"From a@b Thu Jan  1 00:00:00 2026\nFrom: a@b\nSubject: Hi\nDate: Thu, 01 Jan 2026 00:00:00 +0000\nMessage-ID: <1>\n\nBody\n\n"
    (tmp_path / "m.mbox").write_bytes(box)
    mail = registry.run_job(spark, "mbox", {"path": str(tmp_path / "m.mbox")}).collect()
    assert len(mail) == 1 and "Subject: Hi" in mail[0].text and "Date: 2026-01-01" in mail[0].text and mail[0].text.endswith("Body")


def test_crawl(spark):
    page = lambda u, *links: (u, "".join(f'<a href="{x}">x</a>' for x in links))
    pages = spark.createDataFrame([page("http://h/a", "/b", "http://other/x", "#top"), page("http://h/b", "c?q=1#f"), page("http://h/c?q=1", "/d"), page("http://h/d")], "url string, html string")
    links = web.link_table(pages, "url", "html")
    start = spark.createDataFrame([("http://h/a",)], "url string")
    assert [(r.url, r.depth) for r in web.crawl(links, start, 2).collect()] == [("http://h/a", 0), ("http://h/b", 1), ("http://h/c?q=1", 2)]
    twice = spark.createDataFrame([("http://h/p?x=1",), ("http://h/p?x=2",), ("http://h/q",)], "url string")
    assert [(r.path, r.urls) for r in web.path_collisions(twice, "url").collect()] == [("web://h/p", 2)]


def test_obsidian(spark):
    n = spark.createDataFrame([("a.md", "---\naliases: [One, Two]\ntags: x\n---\ntext #y #x [[Other|shown]] [[Third#h]]")], "path string, text string")
    r = files.obsidian_notes(n).first()
    assert (r.aliases, r.tags, r.links) == (["One", "Two"], ["x", "y"], ["Other", "Third"])


def test_index_ignores_null_texts(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    found = spark.createDataFrame([("a", None, 1.0), (None, "x", 1.0), ("b", "text", None)], "path string, text string, mtime double")
    assert ingest.index(cat, found, "s", HashingEmbedder(8)) == {"new": 1}


def test_long_mail_stays_whole():
    from email.message import EmailMessage

    from skarnwell.sources.files import message_parts

    m = EmailMessage()
    m["Subject"] = "long"
    m.set_content("word " * 20_000 + "end")
    for k in range(12):
        m.add_attachment(f"text {k}".encode(), maintype="text", subtype="plain", filename=f"a{k}.txt")
    _, text, files = message_parts(bytes(m))
    assert text.endswith("end") and len(text) > 100_000 and len(files) == 12
