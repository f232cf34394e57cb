"""HTML extraction against a simple recursive renderer, cut-off and long pages, layout and visibility."""

import random
import time

from tracemill.llm import html

RULES = "<style>.gone{display:none} /* x */ b.dim, #none {visibility: hidden} @media print { .kept {display:none} }</style>"


def made(rng, depth=0):
    """A random page part as nested tuples, with no tag implied."""
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "div", "b", "br", "gone", "style", "dim", "shown", "ul", "ol", "kept"])
        if kind in ("text", "br") or depth > 4:
            parts.append(("text", f"w{rng.randint(0, 99)} &lt;{rng.randint(0, 9)}") if kind != "br" else ("br",))
        elif kind in ("ul", "ol"):
            parts.append((kind, [made(rng, depth + 1) for _ in range(rng.randint(1, 3))]))
        else:
            parts.append((kind, made(rng, depth + 1)))
    return parts


def markup(parts):
    tags = {
        "div": ("<div>", "</div>"), "b": ("<b>", "</b>"), "gone": ("<div class='x gone'>", "</div>"), "kept": ("<div class=kept>", "</div>"),
        "style": ("<div style=' DISPLAY : none; color:red'>", "</div>"), "dim": ("<b class=dim>", "</b>"), "shown": ("<i style=visibility:visible>", "</i>"),
    }
    out = []
    for kind, *rest in parts:
        if kind == "text":
            out.append(f" {rest[0]} ")
        elif kind == "br":
            out.append("<br>")
        elif kind in ("ul", "ol"):
            out.append(f"<{kind}>" + "".join(f"<li>{markup(item)}</li>" for item in rest[0]) + f"</{kind}>")
        else:
            out.append(tags[kind][0] + markup(rest[0]) + tags[kind][1])
    return "".join(out)


def expected(parts):
    """Non-empty lines."""
    lines, line, indent, mark = [], [], [""], [None]

    def flush():
        if line:
            front = indent[0] if mark[0] is None else indent[0][: len(indent[0]) - len(mark[0])] + mark[0]
            mark[0] = None
            lines.append(front + " ".join(line))
            line.clear()

    def walk(parts, shows):
        for kind, *rest in parts:
            if kind == "text" and shows:
                line.extend(rest[0].replace("&lt;", "<").split())
            elif kind == "br":
                if mark[0] is not None and not line:  # an empty item line
                    lines.append((indent[0][: len(indent[0]) - len(mark[0])] + mark[0]).rstrip())
                    mark[0] = None
                flush()
            elif kind in ("b", "dim", "shown"):
                walk(rest[0], {"b": shows, "dim": False, "shown": True}[kind])
            elif kind in ("div", "kept"):
                flush()
                walk(rest[0], shows)
                flush()
            elif kind in ("ul", "ol"):
                flush()
                for n, item in enumerate(rest[0], 1):
                    flush()
                    own = f"{n}. " if kind == "ol" else "- "
                    indent[0] += " " * len(own)
                    mark[0] = own
                    walk(item, shows)
                    flush()
                    mark[0] = None
                    indent[0] = indent[0][: len(indent[0]) - len(own)]
                flush()

    walk(parts, True)
    flush()
    return [x for x in lines if x.strip()]


def test_generated_pages():
    rng = random.Random(8)
    for _ in range(400):
        parts = made(rng)
        got = [x for x in html.to_text(RULES + markup(parts)).split("\n") if x.strip()]
        assert got == expected(parts), markup(parts)


def test_cut_off_and_long_pages_take_linear_time():
    start = time.time()
    assert html.to_text("<p>x<a b=" + "\"'" * 5000 + "x" * 1_000_000) == "x"
    assert html.to_text("<a b " * 200_000) == ""
    assert html.to_text("y<script>" + "</scrip" * 100_000) == "y"
    assert len(html.to_text("&" * 300_000)) == 300_000 and html.to_text("<div>" * 100_000 + "x") == "x"
    assert html.to_text("<style>" + "a" * 300_000 + "</style>k") == "k" and html.to_text("k<!-- " + "-" * 300_000) == "k"
    assert time.time() - start < 20


def test_cells_over_several_columns():
    rows = html.to_text("<table><tr><td colspan=2>head<td>z<tr><td>aa<td>bb<td>cc</table>").split("\n")
    assert rows[0].index("z") == rows[1].index("cc")
    rows = html.to_text("<table><tr><td colspan=2>a long heading<td>z<tr><td>aa<td>bb<td>cc<tr><td rowspan=2>r<td>1<td>2<tr><td>3<td>4</table>").split("\n")
    assert rows[0].index("z") == rows[1].index("cc") == rows[2].index("2") == rows[3].index("4") and rows[3].index("3") == rows[2].index("1")


def test_visibility():
    assert html.to_text("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>d").split() == ["b", "d"]
    assert html.to_text("<p style='display:none;display:block'>a<p hidden>b<p hidden=until-found>c").split() == ["a", "c"]
    page = "<style>.h{display:none} p#x.y{visibility:hidden} .h.s{display:block}</style><p class='a h'>no<p id=x class=y>no<p class=y>yes<p class='h s'>so"
    assert html.to_text(page).split() == ["yes", "so"]


def test_numbers_of_lists_are_whole():
    assert html.to_text("<ol start=123456789><li>a<li value=2000000000>b<li>c</ol>").split("\n") == ["123456789. a", "2000000000. b", "2000000001. c"]
