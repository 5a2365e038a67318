from loomflow.sources import imports

FILES = {
    "/src/pkg/__init__.py": "from .a import *\nfrom . import b\nfrom .sub.deep import thing as other\n",
    "/src/pkg/a.py": "import os\nimport os.path as p\nimport pkg.b as bee\nfrom .b import g as f\ndef own():\n    from .sub import deep\n    return 1\n_hidden = 1\ndef _private(): pass\nclass K:\n    def method(self): pass\n",
    "/src/pkg/b.py": "__all__ = ['g', '_shown']\ndef g(): pass\ndef _shown(): pass\ndef unlisted(): pass\nfrom math import gcd\n",
    "/src/pkg/c.py": "from .b import *\nfrom .a import *\nfrom pkg import own as mine, nothing\nimport pkg.sub.deep\n",
    "/src/pkg/sub/__init__.py": "from ..c import *\n",
    "/src/pkg/sub/deep.py": "from ...beyond import x\nfrom .. import a as aa\nfrom ..a import K as thing\ndef twice(): pass\ndef twice(): return 2\nfrom .deep import round1\n",
    "/src/loop1.py": "from loop2 import x\nfrom star2 import *\n",
    "/src/loop2.py": "from loop1 import x\n",
    "/src/star2.py": "from star3 import *\ndef from2(): pass\n",
    "/src/star3.py": "from star2 import *\ndef from3(): pass\n",
    "/src/bad.py": "def (:\n",
    "/src/none.py": None,
}


def test_names_of_all_kinds(spark):
    df = spark.createDataFrame([(p, t, 1) for p, t in FILES.items()], "path string, text string, module int").repartition(3)
    got = {(r["module"], r["name"]): (r["kind"], r["target"], r["attribute"]) for r in imports.resolved(df, "/src").collect()}
    want = {
        ("pkg.a", "os"): ("outside", "os", None),
        ("pkg.a", "p"): ("outside", "os.path", None),
        ("pkg.a", "bee"): ("module", "pkg.b", None),
        ("pkg.a", "f"): ("def", "pkg.b", "g"),
        ("pkg.a", "own"): ("def", "pkg.a", "own"),
        ("pkg.a", "deep"): ("module", "pkg.sub.deep", None),
        ("pkg.a", "_private"): ("def", "pkg.a", "_private"),
        ("pkg.a", "K"): ("def", "pkg.a", "K"),
        ("pkg", "f"): ("def", "pkg.b", "g"),
        ("pkg", "own"): ("def", "pkg.a", "own"),
        ("pkg", "K"): ("def", "pkg.a", "K"),
        ("pkg", "os"): ("outside", "os", None),
        ("pkg", "p"): ("outside", "os.path", None),
        ("pkg", "bee"): ("module", "pkg.b", None),
        ("pkg", "deep"): ("module", "pkg.sub.deep", None),
        ("pkg", "b"): ("module", "pkg.b", None),
        ("pkg", "other"): ("def", "pkg.a", "K"),
        ("pkg.b", "g"): ("def", "pkg.b", "g"),
        ("pkg.b", "_shown"): ("def", "pkg.b", "_shown"),
        ("pkg.b", "unlisted"): ("def", "pkg.b", "unlisted"),
        ("pkg.b", "gcd"): ("outside", "math", "gcd"),
        ("pkg.c", "g"): ("def", "pkg.b", "g"),
        ("pkg.c", "_shown"): ("def", "pkg.b", "_shown"),
        ("pkg.c", "mine"): ("def", "pkg.a", "own"),
        ("pkg.c", "nothing"): ("outside", "pkg", "nothing"),
        ("pkg.c", "pkg"): ("module", "pkg", None),
        ("pkg.sub.deep", "aa"): ("module", "pkg.a", None),
        ("pkg.sub.deep", "x"): ("outside", "beyond", "x"),
        ("pkg.sub.deep", "thing"): ("def", "pkg.a", "K"),
        ("pkg.sub.deep", "twice"): ("def", "pkg.sub.deep", "twice"),
        ("pkg.sub", "g"): ("def", "pkg.b", "g"),
        ("pkg.sub", "mine"): ("def", "pkg.a", "own"),
        ("loop1", "from2"): ("def", "star2", "from2"),
        ("loop1", "from3"): ("def", "star3", "from3"),
        ("star2", "from3"): ("def", "star3", "from3"),
        ("star3", "from2"): ("def", "star2", "from2"),
    }
    assert {k: got.get(k) for k in want} == want
    assert got["loop1", "x"][0] == got["loop2", "x"][0] == "outside"
    assert got["pkg.sub.deep", "round1"][0] == "outside"
    assert ("pkg.c", "_private") not in got and ("pkg.c", "unlisted") not in got and ("bad", None) not in got
    errors = [r["module"] for r in imports.bindings(df, "/src").where("kind = 'error'").collect()]
    assert errors == ["bad"]
    assert imports.resolved(df.limit(0), "/src").collect() == []
