"""Document preparation and units, against small hand-made directories."""

import hashlib

from lodestrata.functions.units import python_units, shell_units, units
from lodestrata.plans import documents as D

FILES = [
    (1, "skill.md", b"# T\n\nbody\n\n"), (1, "README.md", b"r"), (1, "src/a.py", b"x = 1\ny = 2"), (1, "b.sh", b""), (1, "src/z/q.txt", b"\xffok"), (1, "types.d.ts", b"t"),
    (1, "node_modules/m.js", b"m"), (1, "uv.lock", b"l"), (1, "pic.png", b"\x00\x01"), (1, "big.txt", b"a" * 1_000_001), (1, ".md", b"x"), (2, "z.md", b"z"), (2, "a.md", b"a"), (3, "only.bin", None),
]


def test_inventory_hash_lines_and_map(spark):
    listed = D.inventory(spark.createDataFrame(FILES, "p long, path string, content binary")).cache()
    got = {(r.p, r.path): (r.disposition, r.language, r.line_count) for r in listed.collect()}
    assert got[1, "skill.md"] == ("inlined", "markdown", 4) and got[1, "src/a.py"] == ("inlined_source", "python", 2) and got[1, "b.sh"] == ("inlined_source", "shell", 0)
    assert got[1, "types.d.ts"][0] == got[1, "big.txt"][0] == "excluded" and got[1, "pic.png"] == ("excluded", "unknown", 0) and got[1, ".md"][1] == "unknown"
    assert not {(1, "node_modules/m.js"), (1, "uv.lock")} & set(got) and got[2, "a.md"][0] == "inlined" and got[2, "z.md"][0] == "inlined_source"
    sha = {r.p: r.sha256 for r in D.content_hash(listed).collect()}
    assert sha[2] == hashlib.sha256(b"a.md\0inlined\0a\0z.md\0inlined_source\0z\0").hexdigest() and sha[3] == hashlib.sha256(b"only.bin\0excluded\x000\0").hexdigest()
    lines = D.merged_lines(listed).cache()
    two = [(r.text, r.source_file, r.source_line) for r in lines.where("p = 2").orderBy("line").collect()]
    g = D.GENERATED
    assert two == [("a", "a.md", 1), ("", g, 0), (D.HEADING, g, 0), ("", g, 0), ("### z.md", "z.md", 0), ("", "z.md", 0), ("``````text", "z.md", 0), ("z", "z.md", 1), ("``````", "z.md", 0), ("", "z.md", 0)]
    order = [r.source_file for r in lines.where("p = 1 and text like '### %'").orderBy("line").collect()]
    assert order == ["README.md", "b.sh", "src/a.py", "src/z/q.txt"]
    assert lines.where("p = 1 and source_file = 'src/z/q.txt' and source_line = 1").first().text == "\ufffdok"
    ranges = D.source_map(lines)
    assert [tuple(r)[1:] for r in ranges.where("p = 2").orderBy("line_start").collect()] == [(1, 1, "a.md", 1, 1), (2, 4, g, 0, 0), (5, 7, "z.md", 0, 0), (8, 8, "z.md", 1, 1), (9, 10, "z.md", 0, 0)]
    us = spark.createDataFrame([(2, 0, 1, 1), (2, 1, 5, 8), (2, 2, 8, 9), (2, 3, 40, 41)], "p long, id long, line_start int, line_end int")
    assert [tuple(r)[4:] for r in D.translated(us, ranges).orderBy("id").collect()] == [("a.md", 1, 1), (None, 0, 0), ("z.md", 1, 1), (None, 40, 41)]
    assert D.oversized(listed, 10).count() == 1


def test_python_units():
    source = 'import os\nX = 1\nfrom a import (\n  b)\n@deco\n@ other(1)\ndef f(a,\n      b):\n    """d"""\n    return a\nclass C(B):\n    z = 2\n    @p\n    def m(self): pass\nif X:\n    f()\nX += 1'
    got = python_units(source)
    assert [(k, a, b) for k, _, a, b in got] == [
        ("py_import_block", 1, 4), ("py_assign", 2, 2), ("py_decorator", 5, 5), ("py_decorator", 6, 6), ("py_def", 7, 8), ("py_statement", 9, 9), ("py_statement", 10, 10),
        ("py_class_def", 11, 11), ("py_statement", 12, 12), ("py_decorator", 13, 13), ("py_method_def", 14, 14), ("py_statement", 15, 16), ("py_assign", 17, 17),
    ]
    assert got[0][1] == "import os\nfrom a import (\n  b)" and python_units("def (") == [] and python_units("a\0b") == [] and python_units("") == []


def test_shell_units():
    source = '#!/bin/sh\n\nexport A=1\nB=2\n. lib\n\nrun() {\n  echo "}" # }\n  cat <<EOF\n}\nEOF\n  echo $#\n}\nfunction g { x; }\ncat <<-\'END\' >f\n text\nEND\nlast  \n# done'
    got = shell_units(source)
    assert [(k, a, b) for k, _, a, b in got][:2] == [("sh_setup_block", 3, 5), ("sh_function_def", 7, 7)]
    assert ("sh_function_def", "function g { x; }", 14, 14) in got and got[-1] == ("sh_command", "last", 18, 18) and ("sh_heredoc", "cat <<-'END' >f\n text\nEND", 15, 17) in got
    assert shell_units("") == [] and shell_units("# only") == []


def test_units_are_numbered(spark):
    rows = [(1, "b.sh", "shell", "ls\n\npwd"), (1, "a.py", "python", "def ("), (2, "x.txt", "text", None), (3, "y.txt", "text", "\n")]
    got = units(spark.createDataFrame(rows, "p long, path string, language string, text string")).orderBy("p", "id").collect()
    assert [(r.p, r.handle, r.unit_type, r.text, r.line_start) for r in got] == [(1, "su_0", "fenced_code", "def (", 1), (1, "su_1", "sh_command", "ls", 1), (1, "su_2", "sh_command", "pwd", 3)]
