import xml.etree.ElementTree as ET

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrylake.functions import formats as fm
from sentrylake.functions import xml_folds

NAMES = st.sampled_from(["a", "b", "Data", "p:q", "r"])
VALUES = st.text("x <&>\"'é\n", max_size=4)
TREES = st.recursive(
    st.tuples(NAMES, st.dictionaries(st.sampled_from(["Name", "name", "k", "p:k"]), VALUES, max_size=2), VALUES, st.just(())),
    lambda inner: st.tuples(NAMES, st.dictionaries(st.sampled_from(["Name", "name", "k"]), VALUES, max_size=2), VALUES, st.lists(st.tuples(inner, VALUES), max_size=3)),
    max_leaves=12,
)


def written(tree, top=True):
    from xml.sax.saxutils import escape, quoteattr

    name, attributes, text, children = tree
    more = {"xmlns:p": "urn:p"} if top else {}
    inner = escape(text) + "".join(written(c, False) + escape(tail) for c, tail in children)
    return f"<{name}{''.join(f' {k}={quoteattr(v)}' for k, v in (more | attributes).items())}>{inner}</{name}>"


def plain(text):
    """The same pairs from a whole tree, by recursion."""
    local = lambda n: n.rpartition("}")[2]
    out = []

    def walk(e, path, top):
        value, name = (e.text or "").strip(), e.attrib.get("Name", e.attrib.get("name"))
        by_name = name is not None and value != ""
        own = name if by_name else local(e.tag)
        here = "" if top else f"{path}.{own}" if path else own
        for k, v in e.attrib.items():
            if not (by_name and local(k).lower() == "name"):
                out.append((f"{here}.{local(k)}" if here else local(k), v.strip()))
        if value and not (top and len(e)):
            out.append((here or local(e.tag), value))
        for child in e:
            walk(child, here, False)

    walk(ET.fromstring(text), "", True)
    return out or None


@settings(max_examples=300, deadline=None)
@given(tree=TREES)
def test_pairs_equal_those_of_the_whole_tree(tree):
    text = written(tree)
    got = xml_folds.pairs(text, most=10_000)
    assert (None if got is None else [tuple(p.values()) for p in got]) == plain(text)


def test_shapes_and_refusals(spark):
    cases = {
        '<log><time>2026-09-21T10:15:02Z</time><src_ip>10.1.1.5</src_ip></log>': [("time", "2026-09-21T10:15:02Z"), ("src_ip", "10.1.1.5")],
        '<event action="deny"><source ip="10.1.1.5" port="51514"/><destination ip="203.0.113.9"/></event>': [("action", "deny"), ("source.ip", "10.1.1.5"), ("source.port", "51514"), ("destination.ip", "203.0.113.9")],
        '<Event xmlns="urn:e"><System><EventID>4625</EventID><T S="x"/></System><EventData><Data Name="IpPort">5</Data><Data Name="Empty"></Data></EventData></Event>': [
            ("System.EventID", "4625"), ("System.T.S", "x"), ("EventData.IpPort", "5"), ("EventData.Data.Name", "Empty"),
        ],
        "<a><a><a>1</a></a><a>2</a></a>": [("a.a", "1"), ("a", "2")],
        "<a>only text</a>": [("a", "only text")],
        "<a><![CDATA[<b>&amp;</b>]]></a>": [("a", "<b>&amp;</b>")],
        '<?xml version="1.0"?><!DOCTYPE l [<!ENTITY e "x">]><l>&e;</l>': None,
        '<!DOCTYPE foo [<!ENTITY xxe SYSTEM "file:///etc/passwd">]><log><src>&xxe;</src></log>': None,
        "<log><src>10.1.1.5</src><dst>unclosed": None,
        "<134>Sep 21 10:00:00 host text": None,
        "<a/>": None,
        "": None,
        "<log>" + "<f>x</f>" * 8193 + "</log>": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, t string")
    got = {r.i: r.p for r in df.select("i", fm.xml_paths(F.col("t")).alias("p")).collect()}
    for i, want in enumerate([*cases.values(), None]):
        assert (None if got[i] is None else [tuple(p) for p in got[i]]) == want
    deep = "<a>" * 9000 + "1" + "</a>" * 9000
    assert xml_folds.pairs(deep)[0]["key"] == ".".join("a" * 8999)
    many = "<l>" + "".join(f"<f{i}>x</f{i}>" for i in range(500)) + "</l>"
    assert len(xml_folds.pairs(many)) == 400
