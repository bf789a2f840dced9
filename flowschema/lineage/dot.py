"""A lineage graph as Graphviz text."""

from __future__ import annotations

from .graph import Graph

_SHAPES = {"table": "cylinder", "destination": "cylinder", "file": "note", "query": "box", "with": "box", "column": "ellipse", "expression": "ellipse", "star": "ellipse", "name": "plaintext", "create": "folder", "insert": "folder"}
#: The least detail at which a kind of node is shown.
_DETAIL = {"table": 0, "destination": 0, "file": 0, "create": 0, "insert": 0, "query": 1, "with": 1, "values": 1, "function": 1, "lateral": 2, "pivot": 2, "column": 3, "star": 3, "expression": 4, "name": 6}


def to_dot(g: Graph, detail: int = 10, name: str = "lineage") -> str:
    """Nodes up to a level of detail (0 to 10); edges through hidden nodes join what remains."""
    shown = {n.id for n in g.nodes if _DETAIL.get(n.kind, 5) <= detail}
    direct: dict[int, list[tuple[int, str]]] = {}
    for a, b, k in g.edges:
        direct.setdefault(a, []).append((b, k))

    def ends(start: int) -> set[tuple[int, str]]:
        out, stack, seen = set(), list(direct.get(start, ())), set()
        while stack:
            b, k = stack.pop()
            if b in shown:
                out.add((b, k))
            elif b not in seen:
                seen.add(b)
                stack += [(c, k) for c, _ in direct.get(b, ())]
        return out

    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"digraph {name} {{", f"  rankdir={'TB' if len(shown) <= 12 else 'RL'};"]
    lines += [f"  n{n.id} [label={quote(n.kind + (' ' + n.name if n.name else ''))}, shape={_SHAPES.get(n.kind, 'box')}];" for n in g.nodes if n.id in shown]
    lines += [f"  n{a} -> n{b} [label={quote(k)}];" for a in sorted(shown) for b, k in sorted(ends(a))]
    return "\n".join([*lines, "}"]) + "\n"
