"""Structured contents as lines, against a recursive version on random trees."""

import json
import random
import re

from foliospark.operators.content import BLOCKS, CELLS, content_lines

WS = re.compile("[\\s 　﻿]+")


def fold(text):
    return WS.sub(" ", text).strip(" ")


class Flow:
    """Lines [text, id] of nodes one after another."""

    def __init__(self, pre):
        self.pre, self.lines, self.run = pre, [], ""

    def flush(self):
        if self.pre:
            self.lines += [[x, None] for x in self.run.split("\n")] if self.run else []
        else:
            self.lines += [[fold(x), None] for x in self.run.split("\n") if fold(x)]
        self.run = ""

    def add(self, node):
        kind, tag = node["kind"], node.get("tag")
        if kind == "rule":
            self.flush()
        elif kind == "element" and tag in BLOCKS:
            self.flush()
            own = row(node, self.pre) if tag == "tr" else flow(node["children"], self.pre or tag == "pre")
            if own and own[0][1] is None:
                own[0][1] = node.get("id")
            if any(x.strip() for x, _ in own):
                self.lines += own
        elif kind == "text":
            self.run += node["text"] if self.pre else WS.sub(" ", node["text"])
        elif kind == "image":
            self.run += f"[图片：{node['alt'].strip()}]" if node["alt"].strip() else "[图片]"
        elif kind == "break":
            self.run += "\n"
        else:
            for x in node["children"]:
                self.add(x)


def flow(nodes, pre=False):
    own = Flow(pre)
    for x in nodes:
        own.add(x)
    own.flush()
    return own.lines


def plain(nodes):
    """Nodes in which no element has an id or keeps its blanks: a row's text outside its cells."""
    return [x | {"id": None, "tag": "div" if x.get("tag") == "pre" else x.get("tag"), "children": plain(x.get("children", []))} if x["kind"] in ("element", "link") else x for x in nodes]


def row(node, pre):
    is_cell = lambda x: x["kind"] == "element" and x["tag"] in CELLS
    cells = [flow(x["children"], pre) for x in node["children"] if is_cell(x)]
    stray = flow(plain([x for x in node["children"] if not is_cell(x)]), pre)
    if any(x.strip() for x, _ in stray):
        cells.append(stray)
    out = []
    for k, cell in enumerate(cells):
        cell = cell or [["", None]]
        if k:
            out[-1][0] += "\t" + cell[0][0]
            out += cell[1:]
        else:
            out = cell
    return out


def expected(nodes):
    return [tuple(x) for x in flow(nodes)]


def random_tree(rng, depth=0):
    ids = iter(range(10**6))

    def node(depth, inside=None):
        kind = rng.choice(["text"] * 4 + ["image", "break", "rule", "link"] + ["element"] * (6 if depth < 5 else 0))
        if inside == "tr" and rng.random() < 0.7:
            kind = "element"
        if kind == "text":
            return {"kind": kind, "text": rng.choice(["a", " b ", "  ", "\n c\n\n d", "e 　f", "", "\n"])}
        if kind == "image":
            return {"kind": kind, "alt": rng.choice(["", " map ", "x"])}
        if kind in ("break", "rule"):
            return {"kind": kind}
        tag = rng.choice(["td", "td", "th", "p", "b"] if inside == "tr" else ["p", "div", "pre", "tr", "tr", "table", "b", "td", "li"]) if kind == "element" else None
        kids = [node(depth + 1, tag) for _ in range(rng.randint(0, 4))]
        return {"kind": kind, "id": f"n{next(ids)}", "children": kids} | ({"tag": tag} if tag else {})

    return [node(0) for _ in range(rng.randint(0, 4))]


def test_random_trees(spark):
    rng = random.Random(1)
    trees = [random_tree(rng) for _ in range(400)]
    rows = [(i, json.dumps(t), "x", "y") for i, t in enumerate(trees)] + [(1000, None, "x", "y"), (1001, "no json", "x", "y"), (1002, '{"kind": "text"}', "x", "y"), (1003, "[]", "x", "y")]
    found = {}
    for r in content_lines(spark.createDataFrame(rows, "id long, c string, text string, at string").repartition(3), "id", "c").orderBy("id", "line_no").collect():
        assert r.line_no == len(found.setdefault(r.id, []))
        found[r.id].append((r.text, r.node_id))
    assert {i: found.get(i, []) for i in range(len(trees))} == {i: expected(t) for i, t in enumerate(trees)}
    assert not set(found) - set(range(len(trees)))


def test_forms(spark):
    """Literal vectors: a heading, an image in a line, a table, a rule, a note's link, a pre in a link."""
    text = lambda x: {"kind": "text", "text": x}
    el = lambda tag, *kids, **own: {"kind": "element", "tag": tag, "children": list(kids)} | own
    nodes = [
        el("h2", text("目标"), id="h"),
        el("p", text("先看"), {"kind": "image", "alt": "地图"}, text("再走"), id="p"),
        el("table", el("tr", el("td", text("一")), el("td", text("二")), id="r"), id="t"),
        el("p", text("上"), {"kind": "rule"}, text("下"), id="q"),
        el("p", text("见"), {"kind": "link", "children": [el("sup", text("1")), el("pre", text("  a\n\n b"), id="c")]}, id="s"),
    ]
    rows = content_lines(spark.createDataFrame([(1, json.dumps(nodes))], "id long, c string"), "id", "c").orderBy("line_no").collect()
    assert [(r.text, r.node_id) for r in rows] == [("目标", "h"), ("先看[图片：地图]再走", "p"), ("一\t二", "r"), ("上", "q"), ("下", None), ("见1", "s"), ("  a", "c"), ("", None), (" b", None)]
