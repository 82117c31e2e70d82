"""No module binds a name at its top level twice: a later binding would change what an earlier lambda means."""

from __future__ import annotations

import ast
from collections import Counter
from pathlib import Path

import pytest

PACKAGE = Path(__file__).resolve().parent.parent / "strikeline"


def bound(tree: ast.Module) -> list[str]:
    names = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            names.append(node.name)
        elif isinstance(node, ast.Assign):
            names += [x.id for target in node.targets for x in ast.walk(target) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)]
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            names.append(node.target.id)
    return names


@pytest.mark.parametrize("path", sorted(PACKAGE.rglob("*.py")), ids=lambda p: str(p.relative_to(PACKAGE)))
def test_names_are_bound_once(path):
    twice = [n for n, k in Counter(bound(ast.parse(path.read_text()))).items() if k > 1 and n != "_"]
    assert not twice
