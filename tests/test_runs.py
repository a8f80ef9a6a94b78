"""Folders to bundles, end to end, on two small folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from bindery.functions import paths, text as tx
from bindery.operators import filters, sections, stats, tree, upsert
from bindery.options import Options, Source
from bindery.plans import runs
from bindery.sources import folders, sinks

FILES = {
    "harbour/tides.txt": "High water at six, low water at noon.\nBoats leave on the ebb.\n",
    "harbour/quay.py": "BERTHS = 12\n\n\ndef free(taken):\n    return BERTHS - len(taken)\n",
    "harbour/lights.json": '{"north": "green", "south": "red"}\n',
    "harbour/sheds/keys.txt": "Shed two is locked, ask at the office.",
    "harbour/sheds/crates.py": "def volume(w, h, d):\n    return w * h * d\n",
    "orchard/pears.txt": "Pick before the first frost.\n",
    "orchard/press.py": "print('juice')\n",
    "orchard/yield.csv": "row,kilos\n1,40\n2,35\n",
    "orchard/notes/pruning.md": "# Pruning\n\nCut above a bud.\n",
}
ORDER = ["lights.json", "quay.py", "sheds/crates.py", "sheds/keys.txt", "tides.txt"]
BYTES = sum(len(FILES["harbour/" + name]) for name in ORDER)
TREE = """harbour/
├── sheds/
│   ├── crates.py
│   └── keys.txt
├── lights.json
├── quay.py
└── tides.txt"""
STAMP = "2025-11-23 14:00:00"
BAR = "=" * 80


def put(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return root


@pytest.fixture(scope="module")
def projects(tmp_path_factory):
    return put(tmp_path_factory.mktemp("work"), FILES)


def collected(spark, sources, **options):
    rows = runs.collect(spark, sources, Options(**options)).collect()
    kept = sorted((r.bundle, r.rel_path) for r in rows if r.skip_reason is None)
    return kept, {r.rel_path: r.skip_reason for r in rows if r.skip_reason}


def text_of(frame, output_format="standard"):
    rows = sections.bundle_text(frame, output_format).orderBy("bundle", "chunk").collect()
    return "".join(r.text for r in rows)


def test_counts_of_the_samples(spark, projects):
    one, two = str(projects / "harbour"), str(projects / "orchard")
    kept, _ = collected(spark, [Source(one, "p1"), Source(one, "top", exclude_subfolders=True), Source(two, "p2")])
    assert [sum(b == name for b, _ in kept) for name in ("p1", "top", "p2")] == [5, 3, 4]
    many, _ = collected(spark, [Source(one, f"p{i}") for i in range(7)])
    assert len(many) == 35


def test_uri_roots_and_missing_folders(spark, projects):
    uri = (projects / "harbour").as_uri()
    sources = [Source(str(projects / "none"), "none"), Source(uri, "p1"), Source("nosuch://x/y", "odd")]
    rows = runs.collect(spark, sources, Options()).collect()
    assert sorted(r.rel_path for r in rows if r.skip_reason is None) == sorted(ORDER)
    assert {r.bundle: r.skip_reason for r in rows if r.skip_reason} == dict.fromkeys(("none", "odd"), filters.UNLISTED)


def test_links_to_folders_are_not_followed(spark, tmp_path):
    root = put(tmp_path / "l", {"a.txt": "x", "d/b.txt": "y"})
    (root / "d/loop").symlink_to(root)
    (root / "c.txt").symlink_to(root / "a.txt")
    kept, _ = collected(spark, [Source(str(root), "b")])
    assert [p for _, p in kept] == ["a.txt", "c.txt", "d/b.txt"]


def test_every_source_is_reported_in_its_order(spark, projects, tmp_path):
    put(tmp_path / "mixed", {"x.md": "kept", "gone.md": "z"})
    sources = [
        Source(str(projects / "orchard"), "zeta"), Source(str(projects / "missing"), "alpha"),
        Source(str(projects / "harbour"), "mid"), Source(str(tmp_path / "mixed"), "beta"),
    ]
    options = Options(extensions="py, md", detect_binary=False)
    listing = folders.list_files(spark, sources).filter(filters.wanted_extension(F.col("path"), "py, md") | F.col("list_error").isNotNull())
    (tmp_path / "mixed/gone.md").rename(tmp_path / "mixed/gone.bak")
    want = F.when(F.col("list_error").isNull(), folders.WHOLE).otherwise(0)
    files = filters.classify(folders.read_contents(listing.withColumn("want", want)), options)
    files = files.withColumn("text", tx.decode(F.col("content"))).withColumn(
        "display_path", paths.display_path(F.col("top"), F.col("root"), F.col("path"))
    ).drop("content")
    run = runs.Run(files, options, sources=folders.source_table(spark, sources))
    rows = {r.bundle: r for r in run.manifest.collect()}
    assert {b: (r.status, r.total_files, r.skipped_files, r.read_errors) for b, r in rows.items()} == {
        "zeta": ("written", 2, 0, 0), "alpha": (runs.FAILED, 0, 1, 1), "mid": ("written", 2, 0, 0),
        "beta": ("written", 2, 0, 1),
    }
    budget = sorted((r.progress, r.bundle) for r in run.budget.collect())
    assert budget == [("1/4", "zeta"), ("2/4", "alpha"), ("3/4", "mid"), ("4/4", "beta")]
    order = [r.bundle for r in run.all_bundles.orderBy("position").collect()]
    assert list(dict.fromkeys(order)) == ["zeta", "mid", "beta"]
    none = runs.Run(files.filter("bundle = 'alpha'"), options, sources=folders.source_table(spark, sources[1:2]))
    assert [r.status for r in none.manifest.collect()] == [runs.FAILED]


def test_unreadable_files_have_their_own_reason(spark, tmp_path, monkeypatch):
    root = put(tmp_path / "u", {"a.txt": "plain", "b.txt": "plain"})
    listing = folders.list_files(spark, [Source(str(root), "b")]).withColumn("want", F.lit(folders.WHOLE))
    (root / "b.txt").rename(root / "b.bak")
    read = filters.classify(folders.read_contents(listing), Options())
    assert {r.rel_path: r.skip_reason for r in read.collect()} == {"a.txt": None, "b.txt": filters.UNREADABLE}


def test_unusable_ignore_file_gives_way_to_the_next(spark, tmp_path):
    rules = {".gptignore": "[z-a].txt\n", ".gitignore": "*.log\n"}
    bad = put(tmp_path / "bad", {**rules, "a.log": "x", "a.txt": "x"})
    well = put(tmp_path / "well", {".gptignore": "*.txt\n", ".gitignore": "*.log\n", "a.log": "x", "a.txt": "x"})
    kept, _ = collected(spark, [Source(str(bad), "bad"), Source(str(well), "well")], extensions="log, txt")
    assert kept == [("bad", "a.txt"), ("well", "a.log")]


def test_two_sources_cannot_share_a_bundle(spark, projects):
    with pytest.raises(ValueError):
        folders.list_files(spark, [Source(str(projects), "p"), Source("/elsewhere", "p")])


def test_reasons_and_their_order(spark, tmp_path):
    root = put(tmp_path / "src", {
        ".gitignore": "*.md\n", ".gptignore": "# mine\n*.log\n!keep.log\n/gen/\n",
        "a.log": "x", "keep.log": "x", "gen/x.py": "x", "pkg/gen/y.py": "x", "notes.md": "x",
        "pkg/__init__.py": "", "pkg/_private.py": "y", ".hidden/z.py": "z", ".dot.py": "d",
        "Archive/old.py": "\x00", "nul.py": "a\x00", "late.py": b"a" * 1024 + b"\x00",
        "tokens.txt": "t", "bin.key": "k\x00", "safe.key": "k", "big.txt": "b" * 5000, "pic.png": "p",
        "nul_big.txt": "\x00" + "b" * 5000,
    })
    kept, reasons = collected(
        spark, [Source(str(root), "b")], extensions="py, log, md, key, txt", max_size_kb=4
    )
    assert [p for _, p in kept] == [
        ".dot.py", ".hidden/z.py", "keep.log", "late.py", "notes.md", "pkg/__init__.py",
        "pkg/_private.py", "pkg/gen/y.py",
    ]
    assert reasons == {
        "a.log": "matched .gitignore/.gptignore", "gen/x.py": "matched .gitignore/.gptignore",
        "Archive/old.py": "in archive folder", "nul.py": "binary file", "bin.key": "binary file",
        "nul_big.txt": "binary file", "safe.key": "excluded by Safe Mode",
        "tokens.txt": "excluded by Safe Mode", "big.txt": "filtered by size/date criteria",
    }
    kept, reasons = collected(
        spark, [Source(str(root), "b", include_archive=True)], extensions="py", respect_ignore=False,
        detect_binary=False, safe_mode=False,
    )
    assert reasons == {} and {"gen/x.py", "Archive/old.py", "nul.py"} <= {p for _, p in kept}


def test_mtime(spark, tmp_path):
    root = put(tmp_path / "m", {"old.py": "o", "new.py": "n"})
    os.utime(root / "old.py", (1704067199, 1704067199))  # one second before 2024
    os.utime(root / "new.py", (1704067200, 1704067200))
    kept, reasons = collected(spark, [Source(str(root), "b")], modified_after="2024-01-01")
    assert [p for _, p in kept] == ["new.py"] and set(reasons) == {"old.py"}


def test_contents_and_unreadable_files(spark, tmp_path):
    root = put(tmp_path / "u", {"a.txt": b"caf\xc3\xa9\xff\r\nb\rc", "gone.txt": "x", "empty.txt": ""})
    listing = folders.list_files(spark, [Source(str(root), "b")]).withColumn("want", F.lit(folders.WHOLE))
    (root / "gone.txt").rename(root / "moved.bak")
    rows = {r.rel_path: r for r in folders.read_contents(listing).collect()}
    assert bytes(rows["a.txt"].content) == b"caf\xc3\xa9\xff\r\nb\rc"
    assert bytes(rows["empty.txt"].content) == b""
    assert rows["gone.txt"].content is None and "gone.txt" in rows["gone.txt"].read_error
    texts = {r.rel_path: r.text for r in folders.read_files(spark, [Source(str(root), "b")]).collect()}
    assert texts["a.txt"] == "café\nb\nc"


def expected_standard(tree_text):
    head = [
        "Generated by Bindery", f"Timestamp: {STAMP}", "Total files: 5", "PII Sanitization: ENABLED",
        "\n" + BAR, "\nDIRECTORY STRUCTURE:", BAR, tree_text, BAR, "",
    ]
    for name in ORDER:
        body = FILES["harbour/" + name]
        head += [BAR, f"BEGIN FILE: harbour/{name}", BAR, body, BAR, f"END FILE: harbour/{name}", BAR, ""]
        if not body.endswith("\n"):
            head.insert(-4, "")
    return "\n".join(head)


def test_standard_bundle_and_files(spark, projects, tmp_path):
    options = Options(as_of=STAMP)
    files = runs.collect(spark, [Source(str(projects / "harbour"), "port")], options)
    run = runs.Run(files, options)
    want = expected_standard(TREE)
    assert text_of(run.sections) == want
    row = run.stats.first()
    assert row.file_types == {".json": 1, ".py": 2, ".txt": 2}
    assert (row.total_files, row.total_size_bytes) == (5, BYTES)
    assert (row.character_count, row.line_count) == (len(want), want.count("\n") + 1)
    assert row.token_count == len(want) // 4
    assert row.avg_tokens_per_file == round(len(want) // 4 / 5, 2)
    assert row.compression_ratio == round((1 - len(want) / BYTES) * 100, 2)
    assert run.budget.first().progress == "1/1"
    assert run.redactions.count() == run.skips.count() == 0
    assert run.totals.filter("bundle is null").first().files == 5
    run.write(str(tmp_path / "out"))
    parts = sorted((tmp_path / "out/bundles/bundle_file=port_20251123_140000.txt").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == want
    assert spark.read.parquet(str(tmp_path / "out/report")).first().skipped_files == 0


def small(spark):
    rows = [
        ("t", "file2.py", "def goodbye():\n    print('world')", 32),
        ("t", "file1.py", "def hello():\n    a<b & c>d\n", 30),
        ("t", "d/x.csv", "", 0),
    ]
    return spark.createDataFrame(rows, "bundle string, rel_path string, text string, length long").withColumn(
        "display_path", F.concat_ws("/", "bundle", "rel_path")
    ).withColumn("read_error", F.lit(None).cast("string"))


@pytest.mark.parametrize("premeasured", [False, True])
def test_xml(spark, premeasured):
    options = Options(output_format="xml", as_of=STAMP, redact=False, prompt=" Do it.\n")
    files = sections.measure(small(spark), options) if premeasured else small(spark)
    rows = sections.render(files, options)
    doc = "    <document index='{}'>\n      <source>t/{}</source>\n      <document_content>\n{}\n" \
          "      </document_content>\n    </document>\n"
    want = (
        "<!-- System Instructions -->\nDo it.\n\n<?xml version='1.0' encoding='UTF-8'?>\n<context>\n  <metadata>\n"
        f"    <generated_by>Bindery</generated_by>\n    <timestamp>{STAMP}</timestamp>\n"
        "    <total_files>3</total_files>\n    <output_format>xml</output_format>\n  </metadata>\n  <documents>\n"
        + doc.format(1, "d/x.csv", "")
        + doc.format(2, "file1.py", "def hello():\n    a&lt;b &amp; c&gt;d\n")
        + doc.format(3, "file2.py", "def goodbye():\n    print('world')")
        + "  </documents>\n</context>"
    )
    assert text_of(rows, "xml") == want
    for size in (1, 100, 300):
        cut = sections.bundle_text(rows, "xml", max_chars=size).orderBy("chunk").collect()
        assert "".join(r.text for r in cut) == want and len(cut) > 1
    totals = stats.text_totals(rows, "xml").first()
    assert (totals.character_count, totals.line_count) == (len(want), want.count("\n") + 1)


def test_markdown_and_all_bundles(spark):
    options = Options(output_format="markdown", as_of=STAMP, outline=True)
    rows = sections.render(small(spark), options)
    want = (
        f"# AI Context\n\n## Metadata\n- **Generated By**: Bindery\n- **Timestamp**: {STAMP}\n"
        "- **Total Files**: 3\n- **Output Format**: markdown\n- **Pii Sanitization**: ENABLED\n"
        "- **Skeleton Mode**: ENABLED (signatures only)\n\n## Files\n"
        "\n### File: `t/d/x.csv`\n\n```\n\n```\n"
        "\n### File: `t/file1.py`\n\n```python\ndef hello():\n    a<b & c>d\n\n```\n"
        "\n### File: `t/file2.py`\n\n```python\ndef goodbye():\n    print('world')\n```\n"
    )
    assert text_of(rows, "markdown") == want
    totals = stats.text_totals(rows, "markdown").first()
    assert (totals.character_count, totals.line_count) == (len(want), want.count("\n") + 1)
    one = sections.all_bundles(rows, "markdown").orderBy("position").collect()
    assert "".join(r.section + "\n" for r in one) == want + "\n\n"


def test_unreadable_files_are_counted_but_not_printed(spark):
    files = small(spark).withColumn("read_error", F.when(F.col("rel_path") == "file1.py", "gone"))
    rows = sections.render(files, Options(output_format="xml"))
    text = text_of(rows, "xml")
    assert "<total_files>3</total_files>" in text and "file1" not in text and "index='2'>\n      <source>t/file2" in text


def test_tree_last_folder_and_depth(spark):
    files = spark.createDataFrame(
        [("r", p) for p in ("b/c/d.txt", "b/c/e/f.txt", "a/x.txt", "b/z.txt")], "bundle string, rel_path string"
    )
    lines = tree.tree_lines(files).orderBy("key").collect()
    assert "\n".join(r.line for r in lines) == (
        "r/\n├── a/\n│   └── x.txt\n└── b/\n    ├── c/\n    │   ├── e/\n    │   │   └── f.txt\n"
        "    │   └── d.txt\n    └── z.txt"
    )


def test_statistics_sample(spark):
    text = "twelve chars\n" * 1000
    one = spark.createDataFrame([("s", text)], "bundle string, section string").select(
        "bundle", F.length("section").cast("bigint").alias("chars"), F.lit(1000).cast("bigint").alias("lines")
    )
    totals = stats.text_totals(one).first()
    assert (totals.character_count, totals.line_count, totals.token_count) == (13_000, 1001, 3250)


def test_upsert_and_store(spark, tmp_path):
    old = spark.createDataFrame([("a", "k", "1"), ("b", "k", "2")], "name string, key string, value string")
    new = spark.createDataFrame([("b", "k", None), ("c", "k", "4")], "name string, key string, value string")
    merged = {tuple(r) for r in upsert.upsert(old, new, ["name"]).collect()}
    assert merged == {("a", "k", "1"), ("b", "k", None), ("c", "k", "4")}
    assert upsert.upsert(old, new, ["name"], merge=False).count() == 2
    several = spark.createDataFrame([("b", "k", "2"), ("b", "l", "3"), ("a", "l", "5")], old.schema)
    merged = {tuple(r) for r in upsert.upsert(several, new, ["name"]).collect()}
    assert merged == {("a", "l", "5"), ("b", "k", None), ("c", "k", "4")}  # b loses its second setting

    bodies = spark.createDataFrame([("Review", "Line\nTwo")], "name string, body string")
    sinks.export_store(old, bodies, str(tmp_path / "store"), "2024-01-02 03:04:05")
    profiles, templates = sinks.import_store(spark, str(tmp_path / "store"))
    assert {tuple(r) for r in profiles.collect()} == {("a", "k", "1"), ("b", "k", "2")}
    assert [tuple(r) for r in templates.collect()] == [("Review", "Line\nTwo")]

    single = {"profiles": {"P": {"extensions": ".py", "limit": 3, "on": True}}, "prompt_templates": {"T": "x"},
              "exported_at": "2024-01-02 03:04:05", "version": "1.0"}
    (tmp_path / "one.json").write_text(json.dumps(single, indent=2))
    profiles, templates = sinks.import_store(spark, str(tmp_path / "one.json"), multi_line=True)
    assert {tuple(r) for r in profiles.collect()} == {("P", "extensions", ".py"), ("P", "limit", "3"), ("P", "on", "true")}
    assert templates.count() == 1


def test_templates_and_prompts(spark):
    run_rows = spark.createDataFrame([("t", "Review", "old"), ("u", "none", "own")], "bundle string, template string, prompt string")
    bodies = spark.createDataFrame([("Review", "Look closely.")], "name string, body string")
    prompts = sections.with_template(run_rows, bodies)
    assert {r.bundle: r.prompt for r in prompts.collect()} == {"t": "Look closely.", "u": "own"}
    rows = sections.render(small(spark), Options(show_tree=False, prompt="default"), prompts)
    assert text_of(rows).startswith(f"SYSTEM INSTRUCTIONS:\nLook closely.\n\n{BAR}\n\nGenerated by")


def test_stages_in_order(spark, tmp_path):
    body = 'class K:\n    """Mail a@b.co"""\n    def f(self):  # note\n        return 1\n'
    root = put(tmp_path / "p", {"k.py": body, "n.md": "# head\n\nkeep  this\n"})
    options = Options(outline=True, minify=True)
    files = filters_kept(spark, root, options)
    texts = {r.rel_path: r.text for r in runs.prepare(files, options).collect()}
    assert texts == {
        "k.py": 'class K:\n    """Mail <EMAIL_ADDRESS>"""\n    def f(self):\n        ...',
        "n.md": "keep this",
    }


def filters_kept(spark, root, options):
    return runs.collect(spark, [Source(str(root), "p")], options).filter("skip_reason is null")


def test_kept_and_skipped_add_up(spark, projects):
    options = Options(safe_mode=True, min_size_kb=0.1)
    classified = runs.collect(spark, [Source(str(projects / "harbour"), "p")], options)
    assert classified.count() == 5
    assert classified.filter("skip_reason is null").count() + classified.filter(
        "skip_reason is not null"
    ).count() == 5


def test_every_source_of_a_run_is_reported(spark, tmp_path):
    """The documented use: one source with a text, one with only a binary suffix, one empty."""
    put(tmp_path, {"full/a.txt": "one\n", "other/a.bin": "two\n"})
    (tmp_path / "none").mkdir()
    run = runs.Run.over(spark, [Source(f"{tmp_path}/{n}", n) for n in ("none", "full", "other")], Options(as_of=STAMP))
    assert {r.bundle: r.status for r in run.manifest.collect()} == {
        "full": runs.WRITTEN, "other": runs.EMPTY, "none": runs.EMPTY
    }
    assert sorted((r.progress, r.bundle) for r in run.budget.collect()) == [("1/3", "none"), ("2/3", "full"), ("3/3", "other")]
    run.write(str(tmp_path / "out"))
    assert len(list((tmp_path / "out/report").glob("*.parquet"))) >= 1


def test_a_large_bundle_is_several_files_in_order(spark, tmp_path):
    options = Options(as_of=STAMP, output_format="xml")
    rows = sections.render(small(spark), options)
    sinks.write_bundles(rows, str(tmp_path / "out"), options, max_chars=150)
    parts = sorted(next((tmp_path / "out").glob("bundle_file=*")).glob("part-*"))
    assert len(parts) > 2
    assert "".join(p.read_text() for p in parts) == text_of(rows, "xml") + "\n"


def test_settings_keep_their_types(spark, tmp_path):
    values = {"limit": 3, "rate": 2.5, "on": True, "off": None, "list": [1, "a", None, [False]], "text": "3", "map": {"k": [0]}}
    rows = spark.createDataFrame([("P", k, json.dumps(v)) for k, v in values.items()], "name string, key string, value string")
    typed = rows.withColumn("value", F.parse_json("value"))
    none = spark.createDataFrame([], "name string, body string")
    sinks.export_store(upsert.upsert(typed.limit(0), typed, ["name"]), none, str(tmp_path / "store"), STAMP)
    lines = [json.loads(x) for p in (tmp_path / "store").glob("part-*") for x in p.read_text().splitlines()]
    assert [x["profiles"] for x in lines] == [{"P": values}]
    back, _ = sinks.import_store(spark, str(tmp_path / "store"), typed=True)
    got = {r.key: json.loads(r.value) for r in back.select("key", F.coalesce(F.to_json("value"), F.lit("null")).alias("value")).collect()}
    assert got == values


@pytest.mark.parametrize("output_format", ["standard", "xml", "markdown"])
@pytest.mark.parametrize("show_tree", [False, True])
def test_sizes_are_those_of_the_sections(spark, output_format, show_tree):
    options = Options(output_format=output_format, show_tree=show_tree, prompt="Do it.")
    files = spark.createDataFrame(
        [(b, p, f"{b}/{p}", "text\n" * n, None, "naïve")
         for b in ("x", "y") for n, p in enumerate(["a/b/ç.txt", "a/b.txt", "a.txt", "d/e/f/g.py"])],
        "bundle string, rel_path string, display_path string, text string, read_error string, top string",
    )
    drawn = stats.text_totals(sections.render(files, options), output_format)
    assert sorted(drawn.collect()) == sorted(stats.text_totals(sections.sizes(files, options), output_format).collect())
