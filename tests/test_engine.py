import io
import os
import subprocess

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from plainfold import __main__ as cli
from plainfold.functions import prose
from plainfold.markdown import kernel
from plainfold.options import Options
from plainfold.plans import api, queries
from plainfold.sources import files
from plainfold.streaming import documents as streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda cols, data: sorted(repr(tuple(r[cols.index(c)] for c in order)) for r in data)
    assert rows(got.columns, map(tuple, got.collect())) == rows(list(want.columns), want.fetchall())


@pytest.mark.parametrize("options", [Options(), Options("para"), Options("wrap"), Options("wrap", max_width=40), Options("sentence", max_width=80), Options("sentence", max_width=24)], ids=repr)
def test_columns_equal_the_kernel(spark, sf_dir, options):
    """Both ways to reflow plain prose give the same text, which reflows to itself."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    docs = docs.unionAll(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text"))
    odd = spark.createDataFrame([(t,) for t in ("", "a", "\n", "\n\n\n", "A b.\nC d. E\n\n\nF g! H", "x" * 100 + " yy. Zz", "a, " * 60, "\nLead. Two.\n", "One. \nTwo", "end \n")], "text string")
    docs = docs.unionAll(odd).where(prose.is_plain(F.col("text")))
    rows = docs.select("text", prose.reflowed(F.col("text"), options).alias("new")).withColumn("again", F.when(prose.is_plain(F.col("new")), prose.reflowed(F.col("new"), options)).otherwise(F.col("new"))).collect()
    assert len(rows) > 200
    for r in rows:
        assert r.new == kernel.reflow(r.text, options) and r.again == r.new


def test_entry(spark):
    assert driver.entry(spark).count() == 200


def test_api(spark):
    df = spark.createDataFrame([("a", "One. Two."), ("b", "- Item. More.\n"), ("c", None), ("d", "Fine."), ("e", "[a]: b\nnext\n")], "path string, text string")
    got = {r.path: r for r in api.needs_format(df).collect()}
    assert got["a"].formatted == "One.\nTwo." and got["b"].formatted == "- Item.\n  More.\n" and got["c"].formatted is None
    assert [got[k].needs_format for k in "abcde"] == [True, True, False, False, False]
    assert [(r.path, r.start_line, r.reason) for r in api.explain(df).collect()] == [("e", 2, "link-ref-def-neighbor")]
    assert {r.line for r in api.check(api.reflow(df)).collect()} == {"would reformat a", "would reformat b"}
    diff = {r.path: r["diff"] for r in api.unified_diff(api.reflow(df)).collect()}
    assert diff["d"] == "" and diff["c"] is None and "--- b\n+++ b\n" in diff["b"]


def test_stream(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    stream = streams.reflow_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    streams.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), once=True).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, api.reflow(docs).collect()))


@pytest.fixture
def tree(tmp_path):
    made = {
        ".gitignore": "*.tmp.md\n/build/\ndocs/**/draft.md\n!keep.tmp.md\n# note\n",
        "a.md": "One. Two.\n", "_b.MD": "x\n", ".hidden/c.markdown": "x\n", "d.txt": "x\n", "x.tmp.md": "x\n", "keep.tmp.md": "x\n",
        "build/e.md": "x\n", "sub/build/f.md": "x\n", "docs/deep/er/draft.md": "x\n", "docs/.gitignore": "!draft.md\n", "docs/draft.md": "x\n",
        "node_modules/g.md": "x\n", "sub/vendor/h.md": "x\n",
    }
    for name, text in made.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    (tmp_path / ".git").mkdir()
    return tmp_path


def test_walk(tree):
    found = [os.path.relpath(p, tree) for p in files.walk(str(tree), files.Excluder(str(tree), ["sub/*.md"]))]
    assert sorted(found) == [".hidden/c.markdown", "_b.MD", "a.md", "docs/deep/er/draft.md", "docs/draft.md", "keep.tmp.md", "sub/build/f.md"]
    assert files.Excluder(str(tree)).reason(str(tree / "build/e.md")) == ".gitignore"
    assert files.Excluder(str(tree), ["a.md"]).reason(str(tree / "a.md")) == "config"
    assert files.repo_root(str(tree / "docs/deep")) == str(tree)


def test_excludes_agree_with_git(tree):
    (tree / ".git").rmdir()
    if subprocess.run(["git", "init", "-q", str(tree)], capture_output=True).returncode:
        pytest.skip("no git")
    ours = files.Excluder(str(tree))
    for path in sorted(p for p in tree.rglob("*.m*") if ".git/" not in str(p) and not p.is_symlink()):
        git = subprocess.run(["git", "-C", str(tree), "check-ignore", "-q", str(path)], capture_output=True).returncode == 0
        assert (ours.reason(str(path)) == ".gitignore") == git or "built-in" in (ours.reason(str(path)) or ""), path


def test_config(tree):
    conf = tree / files.CONFIG_NAMES[0]
    conf.write_text("mode: wrap\nmax-width: 30\nabbreviations: [zz.]\nexclude: [a.md]\n")
    options, excluded = files.options_for(str(tree / "sub/x.md"), {}, str(tree))
    assert (options.mode, options.max_width, excluded) == ("wrap", 30, ["a.md"])
    assert files.options_for(str(tree / "sub/x.md"), {"max_width": 0}, str(tree))[0].max_width == 0
    for bad in ("colour: red\n", "mode: 3\n", "- a\n", "x: " + "[" * 70 + "]" * 70, "mode: [\n"):
        conf.write_text(bad)
        with pytest.raises(files.ConfigError):
            files.load_config(str(conf))


def test_refusal(spark):
    rows = [("a.md", b"fine"), ("b.PNG", b"x"), ("c.md", b"a\0b"), ("d.md", b"\xff\xfe"), ("e.zzz", b"ok"), ("f.md", b"a" * 8191 + "é".encode()), ("g.md", b"\x10\x01 x"), ("h.md", b"p\n\0 x"), ("i.md", b"word \nmore\0"), ("j.md", b"@\n0 `")]
    got = {r.path: r.why for r in spark.createDataFrame(rows, "path string, content binary").select("path", files.refusal(F.col("path"), F.col("content")).alias("why")).collect()}
    assert {k for k, v in got.items() if v} == {"b.PNG", "c.md", "d.md", "h.md", "i.md"}


def test_explain_keeps_the_table_s_columns(spark):
    df = spark.createDataFrame([("[a]: b\nnext\n", "x", "y", 7)], "text string, `a.b` string, _skip string, reason int")
    r = api.explain(df).collect()[0]
    assert r["a.b"] == "x" and r["_skip"] == "y" and r["reason"] == "link-ref-def-neighbor" and r.start_line == 2
    assert api.reflow(df.withColumnRenamed("text", "t.t"), "t.t").collect()[0]["formatted"] == "[a]: b\nnext\n"


class _Pipe:
    def __init__(self, raw):
        self.buffer = io.BytesIO(raw)


def test_standard_input(tmp_path, monkeypatch, capfdbinary):
    monkeypatch.chdir(tmp_path)

    def run(raw, *flags):
        monkeypatch.setattr("sys.stdin", _Pipe(raw))
        code = cli.main([*flags, "-"])
        out, err = capfdbinary.readouterr()
        return code, out.decode(), err.decode()

    assert run(b"One. Two.\n") == (0, "One.\nTwo.\n", "")
    assert run(b"One. Two.\n", "--check") == (1, "would reformat -\n", "")
    code, out, _ = run(b"One. Two.\n", "--diff")
    assert code == 1 and out.startswith("--- -\n+++ -\n") and "+Two." in out
    assert run(b"Fine.\n", "--check", "--diff") == (0, "", "")
    assert run(b"a\0b")[0] == 3 and run(b"\xff")[0] == 3 and run(b"a\0b\n", "--force")[0] == 0
    code, out, err = run(b"[a]: b\nnext\n", "--explain")
    assert code == 0 and "<stdin>:2: skipped: " in err and "[link-ref-def-neighbor]" in err


def test_version(capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0 and capsys.readouterr().out.startswith("plainfold ")


def test_configuration_stops_at_home(tmp_path, monkeypatch):
    home = tmp_path / "home"
    (home / "a" / "b").mkdir(parents=True)
    (tmp_path / files.CONFIG_NAMES[0]).write_text("mode: para\n")
    monkeypatch.setenv("HOME", str(home))
    found = lambda: files.discover(str(home / "a" / "b"), files.boundary_of(None))
    assert found() is None
    (home / files.CONFIG_NAMES[0]).write_text("mode: wrap\n")
    assert found() == str(home / files.CONFIG_NAMES[0])
    assert files.boundary_of("/x") == "/x"


def test_command_line(spark, tree, capsys):
    path = str(tree / "a.md")
    assert cli.main(["--check", path], spark) == 1 and f"would reformat {path}" in capsys.readouterr().out
    assert cli.main(["--diff", path], spark) == 1 and "+Two." in capsys.readouterr().out
    assert cli.main([path, str(tree / "d.txt")], spark) == 0 and (tree / "a.md").read_text() == "One.\nTwo.\n"
    assert cli.main(["--check", path], spark) == 0
    assert cli.main([str(tree / "x.tmp.md")], spark) == 3
    assert cli.main(["--max-width", "5", path], spark) == 2
    assert cli.main([str(tree / "none.md")], spark) == 2
