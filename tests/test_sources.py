"""Readers of source trees, lock files and listings."""

import json

import pandas as pd
import pytest
from palisade.functions import text as T
from palisade.sources import files as sources
from palisade.sources import lockfiles, observations
from pyspark.sql import functions as F

LOCKS = {
    "Cargo.lock": '[[package]]\nname = "a"\nversion = "1.0.0"\nchecksum = "x"\n[[package]]\nname = "b"\nversion = "2.0.0"\n',
    "package-lock.json": json.dumps({"lockfileVersion": 3, "packages": {"": {"version": "0"}, "node_modules/x": {"version": "1.0.0", "integrity": "sha"}, "node_modules/y/node_modules/@s/z": {"version": "3"}, "node_modules/w": {"link": True}}}),
    "old/package-lock.json": json.dumps({"dependencies": {"m": {"version": "1", "dependencies": {"n": {"version": "2"}}}}}),
    "yarn.lock": '# yarn lockfile v1\n\n"@babel/core@^7.0.0", "@babel/core@^7.1.0":\n  version "7.2.0"\n  integrity sha512-q\n\nlodash@^4:\n  version "4.17.21"\n',
    "pnpm-lock.yaml": "lockfileVersion: '6.0'\npackages:\n  /@types/node@18.0.0:\n    resolution: {}\n  '/left-pad@1.3.0':\n    dev: true\nother:\n  /no@1.0.0:\n",
    "Gemfile.lock": "GEM\n  remote: https://rubygems.org/\n  specs:\n    rails (7.0.0)\n      activesupport (= 7.0.0)\n    rack (2.2.3)\n\nPLATFORMS\n    ruby (1)\n",
    "go.sum": "github.com/a/b v1.0.0 h1:x\ngithub.com/a/b v1.0.0/go.mod h1:y\ngithub.com/c/d v0.1.0/go.mod h1:z\nbad\n",
    "poetry.lock": '[[package]]\nname = "requests"\nversion = "2.0"\n',
    "Pipfile.lock": json.dumps({"default": {"flask": {"version": "==2.0", "hashes": ["h"]}}, "develop": {"pytest": {"version": "==7.0"}}}),
    "requirements.txt": "django==4.0 ; python_version > '3'\nflask>=2\n# c\nuvicorn[std]==0.1\n",
    "bad/Cargo.lock": "not = [toml",
    "bad/package-lock.json": "{",
}


def test_lockfiles(spark):
    files = spark.createDataFrame([*LOCKS.items(), ("node_modules/x/yarn.lock", "q@1:\n  version \"1\"\n"), ("go/go.sum", None), ("e/yarn.lock", "")], "path string, text string")
    files = lockfiles.discovered(files)
    got = {(r.file, r.name, r.version) for r in lockfiles.parsed(files).collect()}
    assert got == {
        ("Cargo.lock", "a", "1.0.0"), ("Cargo.lock", "b", "2.0.0"), ("package-lock.json", "x", "1.0.0"), ("package-lock.json", "@s/z", "3"), ("old/package-lock.json", "m", "1"), ("old/package-lock.json", "n", "2"),
        ("yarn.lock", "@babel/core", "7.2.0"), ("yarn.lock", "lodash", "4.17.21"), ("pnpm-lock.yaml", "@types/node", "18.0.0"), ("pnpm-lock.yaml", "left-pad", "1.3.0"), ("Gemfile.lock", "rails", "7.0.0"), ("Gemfile.lock", "rack", "2.2.3"),
        ("go.sum", "github.com/a/b", "1.0.0"), ("go.sum", "github.com/c/d", "0.1.0"), ("poetry.lock", "requests", "2.0"), ("Pipfile.lock", "flask", "2.0"), ("Pipfile.lock", "pytest", "7.0"), ("requirements.txt", "django", "4.0"), ("requirements.txt", "uvicorn", "0.1"),
    }
    assert [tuple(r) for r in lockfiles.unpinned_requirements(files).collect()] == [("requirements.txt", 1)]


def test_lockfile_texts(spark):
    """Texts of several pieces, empty ones, two of one path: each is read whole and for itself."""
    many = [(f"p\u00e9\U0001f980{i}", f"1.{i}") for i in range(999)]
    toml = "".join(f'[[package]]\r\nname = "{n}"\nversion = "{v}"\n# \U0001f980\n' for n, v in many)
    tree = json.dumps({"dependencies": {n: {"version": v} for n, v in many}}, ensure_ascii=False)
    one = '[[package]]\nname = "a"\nversion = "1"\n'
    files = [("Cargo.lock", toml), ("Cargo.lock", one), ("b/Cargo.lock", ""), ("c/Cargo.lock", None), ("d/Cargo.lock", toml + "x = ["), ("e/Cargo.lock", one), ("package-lock.json", tree), ("f/package-lock.json", tree[:-1]), ("g/package-lock.json", "")]
    files = spark.createDataFrame(files, "path string, text string").coalesce(1)
    got = sorted((r.file, r.name, r.version) for r in lockfiles.parsed(files).collect())
    assert got == sorted([(f, *p) for f in ("Cargo.lock", "package-lock.json") for p in many] + [("Cargo.lock", "a", "1"), ("e/Cargo.lock", "a", "1")])


@pytest.mark.parametrize("kind", ["poetry", "npm_v1", "package_dedup", "cargo"])
def test_lockfile_batches(spark, monkeypatch, kind):
    """What Python holds of texts and rows at once follows neither the number of files nor their size."""
    from palisade.plans import detection

    frame, sizes = type(spark.range(1)), []
    real = frame.mapInPandas

    def spy(self, func, schema):
        def counted(batches):
            seen = []
            kept = (seen.append(b[b.columns[-1]].str.len().max()) or b for b in batches)
            rows = [len(out) for out in func(kept)]
            yield pd.DataFrame({"rows": [max(rows, default=0)], "chars": [max(seen, default=0)]})

        sizes.append(real(self, counted, "rows long, chars long"))
        return real(self, func, schema)

    monkeypatch.setattr(frame, "mapInPandas", spy)
    read, kind, n = (lockfiles.packages, "cargo", 12_000) if kind == "package_dedup" else (detection.READERS[kind], kind, 36_000)
    _, _, head, entry, joint, tail, *_ = detection.LOCKS[kind]
    text = head + joint.join(entry.replace("{p}", str(p)).replace("{v}", "0") for p in range(12_000)) + tail
    files = spark.createDataFrame([(f"s{i}/{detection.LOCKS[kind][0]}", text) for i in range(3)], "path string, text string").coalesce(1)
    assert read(files).count() == n
    assert all(r.rows <= 10_000 and r.chars <= 10_000 for s in sizes for r in s.collect())


def test_tree(spark, tmp_path):
    for path, data in {"node_modules/a/index.js": b"eval(x)", "node_modules/a/README.md": b"x", "node_modules/a/.cache/y.js": b"x", "node_modules/a/b.min.js": b"x", "src/app.js": b"import a from 'a'", ".github/workflows/ci.yml": b"on: push\njobs:", "node_modules/big/i.js": b"a" * 600_000 + b"END"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r.path: r.text for r in sources.dependency_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"node_modules/a/index.js", "node_modules/big/i.js"}
    assert len(got["node_modules/big/i.js"]) == 100_000 and got["node_modules/big/i.js"].endswith("END")
    assert [(r.file, r.line_no, r.line) for r in sources.workflow_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(".github/workflows/ci.yml", 1, "on: push"), (".github/workflows/ci.yml", 2, "jobs:")]


def test_paths(spark):
    cases = {"node_modules/a/x.js": "a", "node_modules/@s/b/x.js": "@s/b", "node_modules/a/node_modules/c/x.js": "c", "vendor/bundle/ruby/3.2.0/gems/rails-7/x.rb": "rails-7", ".venv/lib/python3/site-packages/req/x.py": "req", "src/x.js": None}
    rows = spark.createDataFrame(list(cases), "string").select("value", T.package_of(F.col("value")).alias("p"), sources.package_dir(F.col("value")).alias("d")).collect()
    assert {r.value: r.p for r in rows} == cases
    assert {r.value: r.d for r in rows}["node_modules/a/node_modules/c/x.js"] == "node_modules/a/node_modules/c"
    names = spark.createDataFrame([("@s/a@1.0",), ("a@2",), ("a",)], "v string").select(T.without_version(F.col("v"))).collect()
    assert [r[0] for r in names] == ["@s/a", "a", "a"]


def test_listings(spark):
    lines = spark.createDataFrame([('ESTAB 0 0 10.0.0.1:5 93.184.216.34:443 users:(("npm",pid=12,fd=3))',), ("node  77 u  5u IPv4 TCP 10.0.0.1:1->1.2.3.4:80 (ESTABLISHED)",), ("junk",)], "line string")
    assert {tuple(r) for r in observations.connections(lines).collect()} == {("93.184.216.34", 443, 12, "npm"), ("1.2.3.4", 80, 77, "node")}
    text = ["p10", "cnpm", "f3", "ar", "n/a", "f4", "aw", "n/b", "f5", "n/c"]
    rows = spark.createDataFrame([("l", i, x) for i, x in enumerate(text)], "file string, line_no int, line string")
    assert {tuple(r) for r in observations.open_files(rows).collect()} == {(10, "npm", "/a", False), (10, "npm", "/b", True), (10, "npm", "/c", False)}
    flags = spark.createDataFrame([("0100000",), ("0100001",), ("02",)], "f string").select(observations.writable(F.col("f"))).collect()
    assert [r[0] for r in flags] == [False, True, True]
