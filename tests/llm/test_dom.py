"""Text that a page shows in formulas, objects and xmp blocks."""

from fleetfold.llm import dom


def test_formulas_objects_and_listings_are_text():
    page = (
        "<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2 tex</annotation></semantics></math> holds</p>"
        "<object data='a'><param name='b'><p>instead</p></object><xmp>a <b>&amp;</b> c</xmp><p>end</p>"
    )
    nodes, pieces = dom.read(page)
    assert dom.text_of(pieces, [True] * len(nodes)) == "so x=2 holds instead a <b>&amp;</b> c end"
    assert [n.tag for n in nodes] == ["document", "p", "object", "p", "xmp", "p"]
    assert nodes[4].own == len("a <b>&amp;</b> c") and dom.read("<xmp>never closed")[1][1] == (1, "never closed")
