import pytest
from pyspark.sql import functions as F

from driftloom.llm.names import linked_spellings, near, parse_name, resolve_names

GROUPS = [
    ["Margaret C. Solhegvonith", "M. C. Solhegvonith", "SOLHEGVONITH, M. C.", "So1hegvonith M C", "Peggy Solhégvonith", "Solhegvonith, Margaret", "Prof. Margaret Solhe gvonith", "MargaretC. Solhegvonith"],
    ["Katherine F. Solhegvonith", "Kate F. Solhegvonith", "Solhegvonith, Katherine F."],
    ["Robert G. Bipbafmihund", "Bipbafmihund Robert", "Rob. Bipbafmihund", "R. Bipbafmihund, M.Sc."],
    ["Huvgitkivein Observatory for Symbolic Compound", "HOSC (Huvgitkivein)", "Obs. f. Symbolic Compound, Huvgitkivein", "The Huvgitkivein Observatory of Symb. Compound", "Symbolic Compound: Huvgitkivein Obs.", "Huvgitktvein Observatory of Symbolic Compound"],
    ["Huvgitkivein Institute for Arctic Discourse", "Inst. of Arctic Discourse, Huvgitkivein"],
    ["Johannes Fubpibvedith", "j. fubpibvedith"],
    ["Ulrike Botjekjuzer"],
]


def frame(spark, rows):
    return spark.createDataFrame([(r, "t", 1) for r in rows], "authors array<string>, name string, id int")


def test_groups(spark):
    rows = [[n] for g in GROUPS for n in g] + [[g[0], None, "", "-", "N.N.", "Unknown", "et al.", "anonymous"] for g in GROUPS] * 3 + [None, []]
    found = resolve_names(frame(spark, rows)).collect()
    assert len(found) == len({r.name for r in found}) == sum(map(len, GROUPS))
    groups = {}
    for r in found:
        groups.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, map(set, GROUPS)))
    pairs = {tuple(p) for p in linked_spellings(resolve_names(frame(spark, rows))).collect()}
    assert pairs == {(a, b) for g in GROUPS for a in g for b in g if a < b}


def test_an_initial_of_two_people_links_neither(spark):
    names = ["Margaret Tazfoturith", "Michaela Tazfoturith", "M. Tazfoturith"]
    assert linked_spellings(resolve_names(frame(spark, [names]))).count() == 0


def test_nothing(spark):
    assert resolve_names(frame(spark, [])).count() == 0
    assert resolve_names(frame(spark, [None, [], [None], ["", "-"]])).count() == 0
    assert resolve_names(frame(spark, [["x" * 50_000], ["漢字"], ["Ж. Ж."]])).count() <= 3


@pytest.mark.parametrize("a,b,alike", [("tazbuher", "tazbuher", True), ("tazbuher", "tazbher", True), ("tazbuher", "tazubher", True), ("tazbuher", "tezbuher", True), ("tazbuher", "tezbuhar", False), ("abc", "abd", False)])
def test_near(a, b, alike):
    assert near(a, b) is alike and near(b, a) is alike


def test_parse():
    assert parse_name(None) is None and parse_name("N.N.") is None
    assert parse_name("Dr. K. Solhegvonith")["last"] == ["solhegvonith"]
    assert parse_name("Leonard Tebnartazund, M.Sc.")["first"] == ["leonard"]


def linked(spark, names):
    return {tuple(p) for p in linked_spellings(resolve_names(frame(spark, [names]))).collect()}


def test_letters_of_any_script(spark):
    assert parse_name("Иван Петров")["last"] == ["петров"] and parse_name("Øystein Østby")["last"] == ["ostby"] and parse_name("王小明")["last"] == ["王小明"]
    names = ["Иван Петров", "Петров, Иван", "王小明", "Øystein Østby", "Oystein Ostby", "WHO", "Who", "Kuhn, Thomas", "Khun, Thomas"]
    assert linked(spark, names) == {tuple(sorted(p)) for p in (names[:2], names[3:5], names[5:7], names[7:9])}


def test_initials_and_degrees():
    for name, first, more in (("Ana B. D. Silva", ["ana"], ["b", "d"]), ("M. A. Silva", ["m"], ["a"]), ("Silva, M. A.", ["m"], ["a"]), ("Ana Silva, M.A.", ["ana"], []), ("Silva, Ana, M.A.", ["ana"], []), ("Ana Silva, Ph. D.", ["ana"], [])):
        parsed = parse_name(name)
        assert (parsed["last"], parsed["first"], parsed["more"]) == (["silva"], first, more), name


def test_all_initials_are_united(spark):
    names = ["Ana B. D. Zajhegtebik", "Zajhegtebik, A. B. D.", "A. B. Zajhegtebik", "Ana Zajhegtebik", "Ana C. Pogtebem", "Ana D. Pogtebem"]
    assert linked(spark, names) == {(a, b) for a in names[:4] for b in names[:4] if a < b}


def test_own_nicknames(spark):
    names = ["Xaverina Zajhegtebik", "Vroni Zajhegtebik"]
    assert linked(spark, names) == set()
    found = resolve_names(frame(spark, [names]), nicknames={"Vroni": ["Xaverina"]})
    assert [tuple(p) for p in linked_spellings(found).collect()] == [("Vroni Zajhegtebik", "Xaverina Zajhegtebik")]


def test_long_names(spark):
    long = "x" * 40 + "abcdefgh" * 5
    names = [f"Ana {long}", f"Ana {long[:70]}q{long[71:]}", f"Ana q{long[1:]}", f"Ana {long[::-1]}"]
    assert len(linked(spark, names)) == 3


def test_one_family_name_in_many_spellings(spark):
    """Twenty thousand spellings of people of one family name; every one is linked to its own other form."""
    sounds = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    given = [(x + y + z).capitalize() + "son" for x in sounds for y in sounds[::7] for z in sounds[::5]][:10_000]
    rows = [[f"{g} Wang", f"Wang, {g}"] for g in given]
    found = resolve_names(frame(spark, rows))
    assert found.count() == 2 * len(set(given))
    # a given name one letter away may be the same one misspelt, so only that its own form is there is asked
    mates = found.withColumn("g", F.regexp_replace("name", ",? ?Wang,? ?", ""))
    assert mates.groupBy("g").agg(F.count_distinct("entity").alias("n")).where("n > 1").count() == 0
