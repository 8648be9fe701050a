from whenwhere.operators.session import FORBIDDEN, REQUIRED, SELECTED, UNSELECTED, Session

EDGES = {"Art": [("Modern Art", 0.8), ("Digital Art", 0.7)], "Gallery": [("Modern Art", 0.9)]}


def test_clicks():
    s = Session()
    assert [s.click("A") for _ in range(3)] == [SELECTED, UNSELECTED, SELECTED]
    assert [s.right_click("A") for _ in range(4)] == [REQUIRED, FORBIDDEN, UNSELECTED, SELECTED]


def test_related_tags_take_the_greatest_weight_and_go_with_their_last_parent():
    s = Session(related=lambda t: EDGES.get(t, []))
    s.click("Art")
    s.click("Gallery")
    assert s.weights() == {"Art": 1.0, "Modern Art": 0.9, "Digital Art": 0.7, "Gallery": 1.0}
    assert s.chosen["Modern Art"][0] == s.chosen["Art"][0] != s.chosen["Gallery"][0]
    s.click("Art")
    assert s.weights() == {"Gallery": 1.0, "Modern Art": 0.9}
    s.click("Modern Art")
    assert s.weights(include_related=False) == {"Gallery": 1.0, "Modern Art": 1.0}


def test_forbidden_tags_do_not_count():
    s = Session()
    for _ in range(3):
        s.right_click("A")
    assert s.tag_states().forbidden == ("A",)
    assert s.weights() == {}
    s.clear()
    assert s.state("A") == UNSELECTED
