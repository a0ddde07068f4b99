import ast
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_nothing_imports_the_llm_subpackage():
    for path in (ROOT / "reelgrid").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("reelgrid.llm") for n in names), path
