"""Newick trees."""

from __future__ import annotations

from plait.operators.trees import Tree


def parse(text: str) -> Tree:
    """The tree of one Newick string. Labels may stand in double quotes; single quotes, ``#`` in labels,
    labels given twice and text after the semicolon are errors."""
    tree, i, n = Tree(), 0, len(text)
    if "'" in text:
        raise ValueError("single quotes in Newick text")

    def fail(what: str) -> ValueError:
        return ValueError(f"{what} at {i} in Newick text")

    at = tree.add(None)
    depth, done, labelled = 0, False, False
    while i < n:
        c = text[i]
        if done:
            if not c.isspace():
                raise fail("text after the end")
            i += 1
        elif c == "(":
            if tree.children[at] or labelled:
                raise fail("a parenthesis out of place")
            at = tree.add(at)
            depth, labelled, i = depth + 1, False, i + 1
        elif c == ",":
            if not depth:
                raise fail("a comma outside parentheses")
            at = tree.add(tree.parent[at])
            labelled, i = False, i + 1
        elif c == ")":
            if not depth:
                raise fail("a parenthesis too many")
            at = tree.parent[at]
            depth, labelled, i = depth - 1, False, i + 1
        elif c == ";":
            if depth:
                raise fail("a parenthesis is open")
            done, i = True, i + 1
        elif c == ":":
            j = i + 1
            while j < n and text[j] not in "(),;":
                j += 1
            tree.distance[at] = float(text[i + 1 : j])
            i = j
        elif c.isspace():
            i += 1
        else:
            if labelled:
                raise fail("a second label")
            if c == '"':
                j = text.find('"', i + 1)
                if j < 0:
                    raise fail("an open quote")
                label, i = text[i + 1 : j], j + 1
            else:
                j = i
                while j < n and text[j] not in '(),:;"':
                    j += 1
                label, i = text[i:j].strip(), j
            if "#" in label:
                raise fail("a label with #")
            tree.label[at], labelled = label, True
    if not done:
        raise ValueError("Newick text without a semicolon")
    named = [x for x in tree.label if x]
    if len(named) != len(set(named)):
        raise ValueError("a Newick label twice")
    return tree


def write(tree: Tree) -> str:
    """Newick text with quoted labels."""
    parts: dict[int, str] = {}
    for v in tree.postorder():
        kids = tree.children[v]
        text = f"({','.join(parts.pop(c) for c in kids)})" if kids else ""
        if tree.label[v] or not kids:
            text += f'"{tree.label[v]}"'
        if tree.distance[v] is not None:
            text += f":{tree.distance[v]:g}"
        parts[v] = text
    return parts[tree.root] + ";"
