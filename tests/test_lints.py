import pytest

from prosegrid.operators import lints

#: For each lint: texts, and the quotes that it must find in them, in order.
CASES = {
    "possessive_own": (
        [
            "We rowed to the island's own harbour. Nobody liked the captain's own coffee.",
            "The choir sang in the valley’s own dialect, while the bakers' own bread cooled. The moon has the planet's very own shadow.",
            "Read the gardener's own `seed_list` first, and it's own day will come. Every village brews its own beer. A garden of one's own is enough.",
            "They mixed the baker's and miller's own recipes, and the baker's, miller's, and the grocer's own jars. This is the miller's own and nobody's else.",
        ],
        ["island's own harbour", "captain's own coffee", "valley’s own dialect", "bakers' own bread", "planet's very own shadow", "gardener's own `seed_list`"],
    ),
    "denial_tail": (
        [
            "Good bread should rise slowly in a cool kitchen, not swell within minutes.",
            "The violin rests in its padded wooden case, never on the damp floor.",
            "Water the tall `Ficus lyrata` and the `Monstera` every week; never flood their shallow roots.",
            "Tell your guests something kind about the garden they planted — never leave them with an empty phrase.",
            "Hang the lantern on the hook beside the northern door - not on the old gate.",
            "Trains stop only at the harbour/market platform, never at the upper/lower yard; the bridge is closed; a ferry carries the bicycles across, not the lorries.",
            "The soup is warm, not only for you.",
            "Not a cloud that any sailor has ever feared, not a storm.",
            "Sing it, not.",
            "Write a longer letter to the mayor of this town, not x = y.",
            "Is the ferry late because of fog, not because the pilot slept?",
        ],
        [", not swell within minutes", ", never on the damp floor", "; never flood their shallow roots", "— never leave them with an empty phrase", "- not on the old gate", ", not the lorries"],
    ),
    "not_at_all": (
        [
            "The heron did not move its head at all. The pond has no fish at all, and it doesn't freeze over at all.",
            "That melody is not at all sad to me, not at all.",
            "Why won't the kettle boil at all? Is the stove not lit at all?",
            "Not at all.",
            "B: Not at all.",
            "The tide rises fast or not at all. It barely rains at all.",
        ],
        ["not move its head at all", "no fish at all", "doesn't freeze over at all", "not at all"],
    ),
    "verbs_nothing": (
        [
            "At dawn the fisherman catches nothing, so the cat goes hungry. The cellar has none, and the lamp illuminates nothing.",
            "Under the bed is nothing. This implies nothing good. The drawer holds nothing but keys. The oracle returns nothing. The list shows None.",
        ],
        ["catches nothing", "has none", "illuminates nothing"],
    ),
    "verbs_no_nouns": (
        ["The kiosk sells no tickets. The hut has no chimney, and the path crosses no river.", "There is no ferry. The walk takes no longer. A fence ensures no sheep escape."],
        ["sells no tickets", "has no chimney", "crosses no river"],
    ),
}


@pytest.mark.parametrize("lint", CASES)
def test_places(spark, lint):
    texts, expected = CASES[lint]
    blocks = spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)], "doc_id long, block_id int, text string")
    rows = lints.check(blocks, [lint]).orderBy("block_id", "start").collect()
    assert [r.quote for r in rows] == expected
    assert all(texts[r.block_id][r.start : r.end] for r in rows)


def test_phrases(spark):
    texts = ["Once Upon a time. In the depths of winter it's said that owls whisper, whisper and whispered.", "It’s said that wolves whisper; stage whisper rules."]
    blocks = spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)], "doc_id long, block_id int, text string")
    tokens = lints.read(blocks)
    hits = lints.banned_phrases(tokens, ["once upon", "it's said", "it's said that", "whisper", "in the depths of winter"], ["stage whisper rules"])
    rows = lints.places(blocks, tokens, hits).orderBy("block_id", "start").collect()
    assert [r.quote for r in rows] == ["Once Upon", "In the depths of winter", "it's said that", "whisper", "whisper", "It’s said that", "whisper"]


def test_caps_and_density(spark):
    blocks = spark.createDataFrame([(1, 0, "Paragraph", "DO NOT feed it. RYE OR Spelt. ALWAYS SHUT THE GATES! JAM TEA"), (1, 1, "Item", "x" * 301), (1, 2, "Paragraph", "x" * 600)], "doc_id long, block_id int, kind string, text string")
    runs = lints.caps_runs(lints.read(blocks)).orderBy("pos").collect()
    assert [(r.pos, r.words) for r in runs] == [(0, 2), (9, 4)]
    assert [r.block_id for r in lints.dense_blocks(blocks).collect()] == [1]
