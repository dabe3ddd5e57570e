from pyspark.sql import functions as F

from driftloom.llm.scans import find_noise, furniture_lines, read_lines, repair_fields, repair_texts, scan_distance



def letters(k):
    return "".join("kmpstvwxzj"[int(d)] for d in str(k))


def pages(number, k):
    """A page of prose that differs from document to document, and its page number."""
    return [
        f"In {1900 + k} the {'glacier'} of {letters(k)} was described by readers.",
        f"The mechanism of the glacier in {letters(k)} is federal, as many compilers noted.",
        f"Readers in the registries of {letters(k)} met the mechanism mainly through",
        "the glacier and its vocabulary. The vocabulary was well-known then.",
        "",
        f"Page {number} of 9",
    ]


def corpus():
    return [(k, "\n".join([f"A history of matter {letters(k)} in research", "Some Author", "", *pages(1, 10 * k + 1), *pages(2, 10 * k + 2), *pages(3, 10 * k + 3)])) for k in range(30)]


NOISY = "\n".join(
    [
        "On federal glaciers and the vocabulary",
        "Some Author",
        "",
        "Readers met the mecha-",
        "nism and the glacicr of the vocabu­",
        "3",
        "ON FEDERAL GLACIERS AND THE VOCABULARY",
        "lary, which was well-",
        "known. The g1acier was des-",
        "cribed by rnany compilers.",
        "",
        "12   44   103",
        "7",
        "",
        "4",
    ]
)


def frames(spark, rows, cleaned=()):
    parsed = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "parse_id bigint, text string, line string, k int")
    return parsed, spark.createDataFrame([(c, p, t, "x") for c, p, t in cleaned], "clean_id bigint, parse_id bigint, cleaned_text string, word string")


def test_kinds(spark):
    cleaned = [(5007, 1000, "Readers met the mecha- nism and the glacicr of the vocabulary,\n3 ON FEDERAL GLACIERS AND THE VOCABULARY lary, which was well-known."), (5008, 999, None), (5009, None, "4\nplain text")]
    parsed, clean = frames(spark, [*corpus(), (1000, NOISY), (1001, None), (1002, ""), (None, "x")], cleaned)
    found = {tuple(r) for r in find_noise(parsed, clean).where("record_id in (1000, 5007, 5008)").collect()}
    text = {(n, k) for r, f, n, k in found if f == "text"}
    assert text == {(4, "hyphen"), (5, "misread"), (5, "hyphen"), (6, "furniture"), (7, "furniture"), (9, "hyphen"), (9, "misread"), (10, "misread"), (15, "furniture")}
    assert {(r, n, k) for r, f, n, k in found if f == "cleaned_text"} == {(5007, 1, "hyphen"), (5007, 1, "misread"), (5007, 2, "furniture")}


def test_pages_of_the_corpus(spark):
    parsed, clean = frames(spark, corpus())
    found = find_noise(parsed, clean).collect()
    assert {r.kind for r in found} == {"furniture"} and len(found) == 90


def test_repair(spark):
    parsed, _ = frames(spark, [*corpus(), (1000, NOISY)])
    text = repair_texts(parsed).where("parse_id = 1000").first().text
    assert "Readers met the mechanism and the glacier of the vocabulary, which was well-known. The glacier was described by many compilers." in text
    assert "ON FEDERAL" not in text


def test_stamp(spark):
    stamp = "Scanned copy for internal use only"
    rows = [(k, t + "\n" + stamp if k % 3 == 0 else t) for k, t in corpus()]
    parsed, clean = frames(spark, rows, [(1, 0, f"readers. {stamp} and more")])
    found = find_noise(parsed, clean)
    last = found.where(F.col("field_name") == "cleaned_text").collect()
    assert [tuple(r) for r in last] == [(1, "cleaned_text", 1, "furniture")]
    assert found.where("field_name = 'text'").count() == 90 + 10


def test_repair_of_both_fields(spark):
    """No furniture and no stamp that find_noise reports is left in a text of either field."""
    stamp = "Scanned copy, for internal use only"
    rows = [(k, t + "\n" + stamp if k % 3 == 0 else t) for k, t in corpus()]
    halves = NOISY.replace("mecha-\n", f"mecha-\n{stamp}\n").replace("12   44", f"rows {stamp} follow\n12   44")
    cleaned = [(5007, 1000, f"Readers met the mecha- nism and the glacicr of the vocabulary,\nON FEDERAL GLACIERS AND THE VOCABULARY which was {stamp} well-known.\n{stamp}\nThe end."), (5008, 0, None), (5009, 0, stamp), (5010, 0, "")]
    parsed, clean = frames(spark, [*rows, (1000, halves)], cleaned)
    found = find_noise(parsed, clean).where("kind = 'furniture'").select("record_id", "field_name", "line_no").collect()
    assert {(r.record_id, r.line_no) for r in found if r.field_name != "text"} == {(5007, 2), (5007, 3), (5009, 1)}
    fixed = {(r.field_name, r.record_id): r.text for r in repair_fields(parsed, clean).collect()}
    assert set(fixed) == {("text", k) for k, _ in [*rows, (1000, "")]} | {("cleaned_text", 5007), ("cleaned_text", 5009)}
    assert not [t for t in fixed.values() if stamp in " ".join(t.split()) or "ON FEDERAL" in t or "Page " in t]
    assert "Readers met the mechanism and the glacier of the vocabulary, which was well-known." in fixed["text", 1000] and "rows follow" in fixed["text", 1000]
    assert fixed["cleaned_text", 5007] == "Readers met the mechanism and the glacier of the vocabulary, which was well-known. The end." and fixed["cleaned_text", 5009] == ""


def test_cleaned_text_of_one_line():
    """Of a long line only the furniture of its scan goes, not the prose."""
    header = "ON FEDERAL GLACIERS | Notes on Ice, vol. 4"
    prose = "Readers met the mechanism and the glacier of the vocabulary, which was well-known to the many compilers of the federal registries"
    tail = "whose teachers had met neither a glacier nor any older vocabulary before the third exchange of the archive"
    line = f"{prose} {header} {tail}"
    ((_, noise, _, rest, words, _, _),) = read_lines(line, f"{prose}\n{header}\n{tail}", True)
    assert noise and rest == f"{prose} {tail}" and words.count("vocabulary") == 2 and "ice" not in words
    ((_, noise, _, rest, words, _, _),) = read_lines(line, None, True)
    assert noise and rest == line and words.count("vocabulary") == 2


def test_mark_taken_away_by_a_cleaner(spark):
    """A word that the scan broke is still broken where a cleaner left a blank or a line end for its hyphen."""
    cleaned = [(1, 1000, "Readers met the mecha nism and more.\nThe g1acier was des\ncribed by compilers."), (2, None, "Readers met the mecha nism."), (3, 1000, "Readers met the mecha, nism and the mechanism.")]
    parsed, clean = frames(spark, [*corpus(), (1000, NOISY)], cleaned)
    found = {tuple(r) for r in find_noise(parsed, clean).where("field_name = 'cleaned_text' and kind = 'hyphen'").select("record_id", "line_no").collect()}
    assert found == {(1, 1), (1, 2)}
    fixed = repair_fields(parsed, clean).where("field_name = 'cleaned_text' and record_id = 1").first().text
    assert fixed == "Readers met the mechanism and more. The glacier was described by compilers."


def test_misread_years(spark):
    rows = [(1000, "Dated\n\nIn l855 and in 186o, or 188s, readers met item a12 and x855 in the 1990s, and 100s of more.")]
    parsed, _ = frames(spark, [*corpus(), *rows])
    assert [tuple(r) for r in find_noise(parsed, frames(spark, [])[1]).where("record_id = 1000").collect()] == [(1000, "text", 3, "misread")]
    assert "In 1855 and in 1860, or 1885, readers met item a12 and x855 in the 1990s, and 100s of more." in repair_texts(parsed).where("parse_id = 1000").first().text


def test_nothing(spark):
    assert find_noise(*frames(spark, [])).count() == 0
    assert find_noise(*frames(spark, [(1, None), (2, ""), (3, "\n\n"), (3, "\n\n"), (4, "x" * 300_000)])).count() == 0


def test_furniture_forms():
    assert furniture_lines([]) == set() and furniture_lines(["", ""]) == set()
    lines = ["Title of the paper here", "prose goes on and on,", "- 3 -", "Title of the paper    4", "more prose follows", "17", "cii", "[246] Title of the paper", "Notes on Thing Studies, vol. 4 . Roe and Doe . 101"]
    assert furniture_lines(lines) == {2, 3, 6, 7, 8}
    table = ["Title", "", "12   14", "15", "", "prose"]
    assert furniture_lines(table) == set()


def test_distance():
    assert scan_distance("enzyrne", "enzyme") == scan_distance("g1acier", "glacier") == 0.25
    assert scan_distance("moclificd", "modified") == 0.5
    assert scan_distance("same", "same") == 0 and scan_distance("kernel", "kennel") == 1
