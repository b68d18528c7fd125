"""Proofs about Python sources: unchanged programs, and removal of imports that nothing refers to.

One visit of a module's tree gathers what both need: which names it could refer to, and what each of its import
statements binds and occupies.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

_WORD = re.compile("[A-Za-z_][A-Za-z0-9_]*")
_KEEP = re.compile(r"#\s*noqa", re.IGNORECASE)


@dataclass(frozen=True)
class Import:
    """An import statement: the names it binds (null if they can't be known or have an effect of their own)."""

    node: ast.stmt
    binds: frozenset[str] | None


class Survey(ast.NodeVisitor):
    """What one visit of a module finds."""

    def __init__(self, tree: ast.Module) -> None:
        self.statements = tree.body
        self.mentioned: set[str] = set()
        self.imports: dict[ast.stmt, Import] = {}
        self.visit(tree)

    def visit_Import(self, node: ast.Import) -> None:
        self.imports[node] = Import(node, frozenset(a.asname or a.name.split(".")[0] for a in node.names))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        names = {a.asname or a.name for a in node.names}
        unknowable = node.module == "__future__" or "*" in names
        self.imports[node] = Import(node, None if unknowable else frozenset(names))

    def visit_Name(self, node: ast.Name) -> None:
        self.mentioned.add(node.id)

    def visit_Global(self, node: ast.Global | ast.Nonlocal) -> None:
        self.mentioned.update(node.names)

    visit_Nonlocal = visit_Global

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str):
            self.mentioned.update(_WORD.findall(node.value))

    def needless(self, statement: ast.stmt) -> bool:
        """Whether a statement only imports names that nothing mentions."""
        found = self.imports.get(statement)
        return found is not None and found.binds is not None and not found.binds & self.mentioned

    def shapes(self) -> list[str]:
        """The module's statements without their places."""
        return [ast.dump(s, include_attributes=False) for s in self.statements]


def surveyed(source: str) -> Survey | None:
    """The survey of a source; null if it doesn't parse."""
    try:
        return Survey(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def without_unused_imports(source: str) -> str:
    """A source without the module's import statements of which no name is mentioned.

    A statement goes only with whole lines: it has them to itself, comments aside, and none is marked to be kept.
    """
    survey = surveyed(source)
    if survey is None:
        return source
    lines = source.splitlines(keepends=True)
    for s in reversed([s for s in survey.statements if survey.needless(s)]):
        whole = slice(s.lineno - 1, s.end_lineno)
        behind = lines[whole][-1].encode()[s.end_col_offset :].strip()
        if s.col_offset == 0 and behind[:1] in (b"", b"#") and not _KEEP.search("".join(lines[whole])):
            del lines[whole]
    return "".join(lines)


def removal_checks(before: str, after: str) -> list[tuple[str, bool | None]]:
    """The three checks of an import removal: it parses, nothing else changed, nothing removed is mentioned."""
    old, new = surveyed(before), surveyed(after)
    confined: bool | None = None
    unmentioned: bool | None = None
    if old is not None and new is not None:
        following = iter([*new.shapes(), None])
        expected = next(following)
        left_out: list[ast.stmt] = []
        for statement, shape in zip(old.statements, old.shapes(), strict=True):
            if shape == expected:
                expected = next(following)
            else:
                left_out.append(statement)
        confined = expected is None and all(s in old.imports for s in left_out)
        unmentioned = all(map(old.needless, left_out)) if confined else None
    return [
        ("structural_output_parses", new is not None),
        ("structural_delta_is_import_removal_only", confined),
        ("removed_imports_unreferenced", unmentioned),
    ]


def code_checks(before: str, after: str, language: str | None) -> list[tuple[str, bool | None]]:
    """Whether transformed code parses and is the same program; null where no parser can tell.

    Only Python has a parser on every machine.  Other languages are undecided, never guessed at.
    """
    if language != "python":
        return [("code_semantics_preserved", None)]
    new, old = surveyed(after), surveyed(before)
    same = None if new is None or old is None else new.shapes() == old.shapes()
    return [("code_parses_after", new is not None), ("code_semantics_preserved", same)]
