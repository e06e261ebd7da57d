from conftest import rows

from quillframe.operators import code

SOURCE = '''"""Module doc."""
from pkg.sub import A, B as C
from pkgother import D
from . import E
from .pkg import F1
from pkg import *
import pkg.x

class K(Base, mod.Other, call(), Sub[int]):
    """K doc."""
    class Inner:
        async def run(self):
            """Run doc.

              indented
            """
    def m(self):
        def local():
            """Local doc."""

if True:
    class Hidden(K):
        """Hidden doc."""

def f():
    """First."""

def f():
    """Last."""

def f():
    pass

def module():
    """Takes the module key."""

class K:
    """"""
'''


def parsed(spark, *sources):
    files = spark.createDataFrame([(f"f{i}.py", s) for i, s in enumerate(sources)], "path string, content string")
    return code.parse_modules(files)


def test_symbols(spark):
    assert rows(code.symbols(parsed(spark, SOURCE)), "position", "qualified_name", "kind", "docstring") == [
        (0, "module", "function", "Takes the module key."),
        (1, "K", "class", "K doc."),
        (2, "K.Inner.run", "async function", "Run doc.\n\nindented"),
        (3, "K.m.local", "function", "Local doc."),
        (4, "f", "function", "Last."),
    ]


def test_classes_come_from_the_whole_tree(spark):
    table = code.class_parents(parsed(spark, SOURCE))
    assert rows(table, "position", "class_name", "parents") == [(0, "K", []), (1, "Inner", []), (2, "Hidden", ["K"])]
    first = "class K(Base, mod.Other, call(), Sub[int]):\n    pass\n"
    edges = code.class_edges(code.class_parents(parsed(spark, first)))
    assert [r[3] for r in rows(edges)] == ["Base", "Other", "Unknown", "Unknown"]


def test_imports(spark):
    table = code.import_list(parsed(spark, SOURCE))
    assert rows(table, "ordinal", "module", "name") == [
        (0, "pkg.sub", "A"), (1, "pkg.sub", "B"), (2, "pkgother", "D"), (3, None, "E"), (4, "pkg", "F1"), (5, "pkg", "*"),
    ]
    assert [r[0] for r in rows(code.imports_from(table, "pkg"), "name")] == ["A", "B", "F1"]
    assert code.import_query(parsed(spark, SOURCE), "pkg").first()["query"] == "A B F1"


def test_unparsable_sources_give_no_rows(spark):
    bad = parsed(spark, "def (", "x = '\0'", None, "\ufeffx = 1", "(" * 5000)
    assert code.symbols(bad).count() == code.import_list(bad).count() == code.class_parents(bad).count() == 0
    assert bad.where("parse_error IS NOT NULL").count() == 5
    assert {r[0] for r in rows(code.compiled_docstrings(bad), "compiled")} == {""}


def test_compiled_and_described(spark):
    source = '"""\n  Top.\n\nMore."""\ndef f():\n    """F doc."""\nclass C:\n    def g(self):\n        """\n        G first\n        G second"""\n'
    frame = parsed(spark, source)
    assert code.compiled_docstrings(frame).first().compiled == (
        "module (module):\n  Top.\n\nMore.\n\nf (function):\nF doc.\n\nC.g (function):\nG first\nG second"
    )
    assert code.docstring_descriptions(frame).first().description == "module: Top.; f: F doc.; g: G first"


def test_class_docstring_lookup(spark):
    source = "class A:\n    class B:\n        'inner'\nclass B:\n    'outer'\nclass N:\n    pass\n"
    asked = spark.createDataFrame([("f0.py", c) for c in ("A", "B", "N", "Z")] + [("no.py", "A")], "path string, class_name string")
    found = rows(code.class_docstrings(asked, parsed(spark, source)), "path", "class_name", "docstring")
    assert found == [("f0.py", "A", None), ("f0.py", "B", "outer"), ("f0.py", "N", None), ("f0.py", "Z", ""), ("no.py", "A", "")]
