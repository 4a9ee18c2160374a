from __future__ import annotations

import pytest
from helpers import env_files_of, files_of, rows

from envtally.functions.names import DEFAULT_PATTERNS
from envtally.operators import extract as X
from envtally.operators.lines import logical_lines


def uses(df):
    return rows(df, "path", "line_no", "variable")


def test_env_declarations(spark):
    text = (
        "# A_COMMENT=1\n\n  LEADING=1\n\tTAB=1\nSPACE_BEFORE =1\nEMPTY=\nQUOTED=\"a=b\"\nDUP=1\nDUP=2\r\n"
        "export EXPORTED=1\nlower=1\nMixed=1\n1DIGIT=1\nDA-SH=1\nDO.T=1\nNOVALUE\n=X\nVT\x0b=1\nLAST=1"
    )
    env = env_files_of(spark, {".env": text, ".env.bom": "\ufeffFIRST=1\nSECOND=1", "gone": None})
    got = rows(X.env_declarations(env), "env_path", "variable")
    names = ["DUP", "EMPTY", "LAST", "LEADING", "QUOTED", "SPACE_BEFORE", "TAB"]
    assert got == [(".env", n) for n in names] + [(".env.bom", "SECOND")]


def test_js_references(spark):
    js = (
        'const a = process.env.A1; f(process.env["B"], process.env[\'C\']);\r\n'
        "process.env.A1 + process.env.A1\n"
        "process.env[key]; process.env.lower; process.env.Mixed; process.env[`T`]; myprocess.env.OWN\n"
        "// process.env.IN_COMMENT process.env[\"BAD']"
    )
    files = files_of(spark, {"x.js": js, "y.ts": "process.env.T", "z.go": "process.env.NO", "Dockerfile.js": js})
    assert uses(X.js_references(files)) == sorted(
        [("x.js", 1, "A1"), ("x.js", 1, "B"), ("x.js", 1, "C"), ("x.js", 2, "A1"), ("x.js", 2, "A1"),
         ("x.js", 3, "M"), ("x.js", 3, "OWN"), ("x.js", 4, "IN_COMMENT"), ("y.ts", 1, "T")], key=str
    )


def test_go_references(spark):
    go = 'os.Getenv("A"); os.LookupEnv("B")\nos.Getenv(name); os.Getenv( "C"); os.Getenv("D" ); os.Getenv("e")'
    assert uses(X.go_references(files_of(spark, {"x.go": go}))) == [("x.go", 1, "A"), ("x.go", 1, "B")]


def test_python_references(spark):
    py = (
        "os.getenv(\"A\"); os.environ['B']; os.environ[\"C\"]\n"
        "os.getenv('D'); os.getenv(\"E\", 1); os.environ.get(\"F\"); os.environ[g]; os.environ[\"H']"
    )
    got = uses(X.python_references(files_of(spark, {"x.py": py})))
    assert got == [("x.py", 1, "A"), ("x.py", 1, "B"), ("x.py", 1, "C")]


def test_code_references_skip_dockerfiles_and_take_more_languages(spark):
    files = files_of(
        spark,
        {"a.js": "process.env.A", "Dockerfile.py": 'os.getenv("B")', "c.rb": "ENV['C'] ENV.fetch('D')", "d.js": None},
    )
    assert uses(X.code_references(files)) == [("a.js", 1, "A")]
    ruby = {**DEFAULT_PATTERNS, ".rb": [r"ENV\['([A-Z_]+)'\]", r"(?:ENV)\.fetch\('([A-Z_]+)'\)"]}
    assert uses(X.code_references(files, ruby)) == [("a.js", 1, "A"), ("c.rb", 1, "C"), ("c.rb", 1, "D")]


def test_oversize_files_have_no_facts(spark):
    files = files_of(spark, {"a.js": "process.env.A\n" + "x" * 30, "b.js": "process.env.B"})
    assert uses(X.code_references(files, max_line_bytes=20)) == [("b.js", 1, "B")]
    failed = rows(X.extract_facts(files, max_line_bytes=20), "role", "variable", "path", "line_no")
    assert failed == [("code_used", "B", "b.js", 1), ("oversize", None, "a.js", None)]


def test_malformed_utf8_is_read_as_it_is(spark):
    data = [
        ("a.js", b"\xe2process.env.A\xff\n\xe2"), ("Dockerfile", b"\xe2\nFROM x\nENV A=\xf0 B=1 \xe2\nRUN $C\xe2\n \xf0"),
        ("b.py", b"os.getenv(\"B\xff\")"),
    ]
    files = spark.createDataFrame([("p", p, bytearray(c)) for p, c in data], "project string, path string, content binary")
    facts = X.extract_facts(files.withColumn("content", files.content.cast("string")))
    assert rows(facts, "role", "variable", "line_no") == [
        ("code_used", "A", 1), ("docker_declared", "A", 3), ("docker_declared", "B", 3), ("docker_used", "C", 4)
    ]


def docker(spark, text):
    return logical_lines(files_of(spark, {"Dockerfile": text}))


@pytest.mark.parametrize(
    ("line", "names"),
    [
        ("ENV A=1", ["A"]), ("env A=1 B=2", ["A", "B"]), ("ENV A value with = sign", []), ("ENV A some value", ["A"]),
        ("ENV A", ["A"]), ('ENV A="x Y=1"', ["A", "Y"]), ("ENV a=1 B=2", ["B"]), ("ENV KEY a=b", []),
        ("ENV =A B=1", ["B"]), ("ENV\tA=1", ["A"]), ("ENV\x0bA=1", []), ("ENVA=1", []), ("ENV \u3000A=1", ["A"]),
        ("  Env A=1\u2003B=2", ["A", "B"]), ("ENV A\u00a0x", ["A"]), ("ENV A-B x", []), ("ENV A== B=", ["A", "B"]),
        ("ENV A=1 \\\n  B=2 c=3 \\ \n D=4", ["A", "B", "D"]), ("ENV", []), ("RUN ENV A=1", []), ("ENV A=1 A=2", ["A", "A"]),
    ],
)
def test_docker_env(spark, line, names):
    assert [r[2] for r in uses(X.docker_env_declarations(docker(spark, "FROM x\n" + line)))] == names


def test_docker_arg(spark):
    cases = {
        "ARG A": "A", "arg A=1": "A", "ARG A=1 B=2": "A", "ARG A B": None, "ARG lower": None, "ARG =A": None,
        "ARG A =1": "A", "ARG": None, "ARG A=": "A", "ARG\fA": "A", "ARG \u2003A": "A", "ARG A-B=1": None,
        "ARG A B=1": None, "ARGA": None,
    }
    lines = docker(spark, "FROM x\n" + "\n".join(cases))
    got = {r.line_no: r.variable for r in X.docker_arg_declarations(lines).collect()}
    assert got == {n: name for n, name in enumerate(cases.values(), 2) if name}


def test_docker_references(spark):
    text = "FROM $IMG:${TAG}\n# $NO\nRUN $A ${A} ${B:-d} \\\n # $C $$D \\$E\nRUN $Foo $bar ${ G} $1X\nENV Z=$Y"
    got = uses(X.docker_references(docker(spark, text)))
    assert [(n, v) for _, n, v in got] == [
        (1, "IMG"), (1, "TAG"), (3, "A"), (3, "B"), (3, "C"), (3, "D"), (3, "E"), (4, "F"), (5, "Y")
    ]


def test_valid_dockerfiles(spark):
    texts = {
        "FROM x": True, "from x": True, "# c\n\n  From\tx": True, "FROM": False, "FROM  \n": False, "RUN a \\\nFROM x": False,
        "# c \\\nFROM x": False, "FROM \\\n x": True, "FROMx": False, "FROM\x0bx": False, "\u3000FROM x": True, "": False,
        "FROM \u3000\n": False, "a\rFROM x": False, "a\u2028FROM x": False, "ENV A=1": False,
    }
    files = files_of(spark, {f"{n}.dockerfile": text for n, text in enumerate(texts)})
    got = {int(r.path.split(".")[0]) for r in X.valid_dockerfiles(files).collect()}
    assert got == {n for n, valid in enumerate(texts.values()) if valid}


def test_docker_declarations_join_all_stages_and_files(spark):
    files = files_of(
        spark,
        {
            "Dockerfile": "FROM a\nENV A=1\nFROM b\nARG B\nENV A=2", "x/Dockerfile.prod": "FROM c\nENV C 1",
            "bad.dockerfile": "ENV NO=1", "src.js": "FROM x\nENV NO=1",
        },
    )
    assert rows(X.docker_declarations(files), "variable") == [("A",), ("B",), ("C",)]
