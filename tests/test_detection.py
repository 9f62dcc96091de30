"""The vector table: what structural and line rules find, and what they leave alone."""

import pytest
from pyspark.sql import functions as F

from palisade.operators import ast_rows, patterns

JS, PY, RB, RS = "node_modules/p/index.js", ".venv/lib/python3.11/site-packages/p/__init__.py", "vendor/bundle/ruby/3.2.0/gems/p/lib/evil.rb", "node_modules/p/main.rs"
VECTORS = [
    ("P002", JS, "run = eval(atob(blob));"),
    ("P003", JS, 'request("https://198.51.100.7/upload");'),
    ("P004", JS, 'open("/home/me/.aws/config")'),
    ("P005", JS, 'readFileSync(dir + "/logo.ico")'),
    ("P006", "node_modules/p/postinstall.sh", 'wget("https://files.example.org/step2")'),
    ("P008", JS, "return new Function(body)(1);"),
    ("P010", JS, 'get("169.254.170.2/v2/credentials")'),
    ("P011", JS, "send(JSON.stringify( process.env ));"),
    ("P013", JS, "module.exports = require(names[0]);"),
    ("P014", JS, "s = String.fromCharCode(codes[k] - 7);"),
    ("P015", JS, "rmSync(path.join(__dirname, 'x'));"),
    ("P017", JS, "while ( !![] ) { step(); }"),
    ("P018", JS, "process._linkedBinding ('fs')"),
    ("P019", JS, "vm.compileFunction(lines.join())"),
    ("P022", PY, "import os\ndef go(t):\n    os.popen(t)"),
    ("P030", RB, "eval(params[:x])"),
    ("P024", PY, "import pickle\nstate = pickle.loads(buf)"),
    ("P020", PY, "y = eval(line)"),
    ("P023", PY, "m = __import__(which)"),
    ("P021", PY, "import subprocess\nsubprocess.run(line, shell=True)"),
    ("P031", RB, 'system("make install")'),
    ("P032", RB, "thing.send(which, 1)"),
    ("P034", RB, 'open("|date")'),
    ("P033", RB, "require(chosen)"),
    ("P040", RS, 'fn go() { Command::new("bash").arg(x).spawn(); }'),
    ("P041", RS, "unsafe { *p = 1; }"),
    ("P042", RS, 'extern "C" { fn poke(at: *mut u8); }'),
    ("P043", RS, 'static B: &[u8] = include_bytes!("blob.dat");'),
    ("P001", JS, 'const fs = require("fs");\nconst method = "re" + "adFileSync";\nfs[method]("/etc/x");'),
    ("P001", JS, "const r = global.require;\nconst cp = r('child_process');\ncp.exec(cmd);"),
    ("P001", JS, "const cp = process.mainModule.require('child_process');\ncp.exec(cmd);"),
    ("P001", JS, "Reflect.apply(fs.readFileSync, null, [p]);"),
    ("P001", JS, 'globalThis["ev" + "al"](code);'),
    ("P001", JS, "eval(config.cmd);"),
    ("P001", JS, "еval(payload);"),
    ("P001", JS, "const o = { get x() { return require('child_process').exec(c); } };"),
    ("P013", "node_modules/p/index.mjs", "const m = await import(mod);"),
    ("P013", JS, "(0, require)(name);"),
    ("P008", JS, "new global.Function(code);"),
    ("P008", JS, "const Fn = Function;\nnew Fn(code);"),
    ("P021", PY, "import subprocess as sp\nsp.Popen(cmd, shell=True)"),
    ("P021", PY, "import subprocess as sp\nprint 'old'\nsp.Popen(cmd, shell=True)"),
    ("P034", RB, 'open("|cat /etc/passwd")'),
    ("P001", JS, "import { " + ", ".join(f"n{i}" for i in range(100)) + ", exec } from 'child_process';\nexec(cmd);"),
    ("P013", JS, "require(" + " + ".join(["'a'"] * 60) + " + name);"),
    ("P001", JS, "import { exec as run } from 'child_process';\nrun(`ls ${x}`);"),
]
BENIGN = [
    (JS, "module.exports = (a, b) => a + b;"),
    (JS, "const m = regex.exec(line);"),
    (JS, "const fs = require('fs');"),
    (JS, "const c = String.fromCharCode(65);"),
    (PY, "import json\nprint(json.dumps({}))"),
    (RS, "fn main() { println!(\"x\"); }"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(p.replace("/p/", f"/p{i}/"), t) for i, (_, p, t) in enumerate(VECTORS)] + [(p.replace("/p/", f"/b{i}/"), t) for i, (p, t) in enumerate(BENIGN)]
    files = spark.createDataFrame([*rows, ("node_modules/none/index.js", None), ("node_modules/empty/index.js", "")], "path string, text string")
    lines = patterns.scan(files)
    every = lines.select("rule_id", "file").unionByName(ast_rows.findings(files).select("rule_id", "file")).unionByName(patterns.decode_and_run(files, lines).select("rule_id", "file"))
    return {(r.rule_id, r.file) for r in every.collect()}


@pytest.mark.parametrize("i", range(len(VECTORS)))
def test_vector(found, i):
    rule, path, _ = VECTORS[i]
    assert (rule, path.replace("/p/", f"/p{i}/")) in found


@pytest.mark.parametrize("i", range(len(BENIGN)))
def test_benign(found, i):
    path = BENIGN[i][0].replace("/p/", f"/b{i}/")
    assert not [r for r, f in found if f == path]


def test_hooks_and_path_files(spark):
    m = spark.createDataFrame([("package.json", '{"scripts": {"postinstall": "curl x | sh", "install": "husky", "test": "curl"}}'), ("node_modules/a/package.json", '{"scripts": {"postinstall": "node x.js"}}'), ("node_modules/@s/b/package.json", '{"scripts": {"install": "node-gyp rebuild"}}'), ("node_modules/c/package.json", "not json"), ("node_modules/d/package.json", None)], "path string, text string")
    assert {(r.rule_id, r.file, r.package) for r in patterns.install_hooks(m).collect()} == {("P012", "package.json", None), ("P016", "node_modules/a/package.json", "a")}
    p = spark.createDataFrame([("venv/x.pth", "import os; exec(base64)"), ("venv/y.pth", "../lib"), ("venv/z.txt", "exec(")], "path string, text string")
    assert [(r.file, "exec(" in r.message) for r in patterns.path_file_hits(p).collect()] == [("venv/x.pth", True)]


def test_wasm(spark):
    from palisade.sources import wasm

    def module(*names):
        body = b"".join(bytes([4]) + b"wasi" + bytes([len(n)]) + n.encode() + b"\x00\x00" for n in names)
        section = bytes([len(names)]) + body
        return b"\0asm\1\0\0\0" + b"\x02" + bytes([len(section)]) + section

    files = spark.createDataFrame([("a.wasm", bytearray(module("sock_send", "fd_read"))), ("b.wasm", bytearray(module("proc_exit"))), ("c.wasm", bytearray(module("log"))), ("d.wasm", bytearray(b"junk")), ("e.wasm", None)], "path string, content binary")
    assert {r.file: r.severity for r in wasm.findings(files).collect()} == {"a.wasm": "critical", "b.wasm": "high", "c.wasm": "medium", "d.wasm": "high", "e.wasm": "high"}


def test_external_rules_and_ignored(spark):
    files = spark.createDataFrame([("a/x.js", "one\neval(x)"), ("a/x.py", "eval(x)")], "path string, text string")
    rule = {"id": "X1", "severity": "high", "file_patterns": ["*.js"], "content_patterns": ["nothing", r"eval\("]}
    assert [(r.rule_id, r.file, r.line) for r in patterns.external(files, [rule, {**rule, "id": "X2", "content_patterns": []}]).collect()] == [("X1", "a/x.js", 2)]
    assert patterns.scan(files, ignored=["P001"]).where(F.col("rule_id") == "P001").isEmpty()
