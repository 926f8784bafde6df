"""Entities, imports, JavaScript symbols and base classes."""

import pytest

from sievestone.sources import code, tree

FILES = {
    "pkg/__init__.py": "",
    "pkg/core.py": "import os\nfrom . import util\nfrom .util import helper as h, missing\nfrom pkg.sub import deep\n\nLIMIT = 3\nname: str = 'x'\n__version__ = '1'\n\nclass Base:\n    pass\n\nclass Child(Base, object):\n    inner = 1\n",
    "pkg/util.py": "def helper():\n    pass\n",
    "pkg/sub/__init__.py": "",
    "pkg/sub/deep.py": "from ..util import helper\nfrom ..core import Base\n\nclass Far(Base):\n    pass\n",
    "pkg/bad.py": "def (:\n",
    "web/app.js": "export class App {\n  render() {\n    if (x) {\n    }\n  }\n}\nexport const go = async (a) => {\n};\nfunction plain() {\n}\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return tree.scan_tree(spark, str(root)).cache()


def test_entities(files):
    got = {(r.name, r.entity_type) for r in code.python_entities(files).filter("path = 'pkg/core.py'").collect()}
    assert got == {("os", "import"), ("util", "import"), ("h", "alias"), ("missing", "import"), ("deep", "import"), ("LIMIT", "config_constant"), ("name", "variable")}


def test_imports_resolve(files):
    symbols = tree.python_symbols(files)
    got = {(r.path, r.name): (r.target_path, r.symbol_id) for r in code.resolve_imports(code.python_entities(files), files, symbols).collect()}
    ids = {(r.path, r.name): r.symbol_id for r in symbols.filter("not parse_error").collect()}
    assert got == {
        ("pkg/core.py", "util"): ("pkg/util.py", None),
        ("pkg/core.py", "h"): ("pkg/util.py", ids["pkg/util.py", "helper"]),
        ("pkg/core.py", "missing"): ("pkg/util.py", None),
        ("pkg/core.py", "deep"): ("pkg/sub/deep.py", None),
        ("pkg/sub/deep.py", "helper"): ("pkg/util.py", ids["pkg/util.py", "helper"]),
        ("pkg/sub/deep.py", "Base"): ("pkg/core.py", ids["pkg/core.py", "Base"]),
    }


def test_javascript(files):
    assert {(r.name, r.kind, r.start_line) for r in code.javascript_symbols(files).collect()} == {("App", "class", 1), ("render", "method", 2), ("go", "function", 7), ("plain", "function", 9)}


def test_base_classes(files):
    symbols = tree.python_symbols(files).filter("not parse_error").cache()
    names = {r.symbol_id: r.name for r in symbols.collect()}
    assert {(names[r.src], names[r.dst]) for r in code.base_classes(files, symbols).collect()} == {("Child", "Base"), ("Far", "Base")}
