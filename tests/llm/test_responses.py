import pytest

from driftloom.llm.responses import find_defects, goes_on, judge, truncation_evidence

SENTENCE = "The term is central in 1926 but already temporal in the estimate of 1964."
GERMAN = "In den 1890er Jahren galten digitale Muster noch als Beleg für den Begriff."
QUESTION = "Which sources first mention moral record?"

CASES = [
    (QUESTION, SENTENCE, ""),
    (QUESTION, SENTENCE + " [1][4]", ""),
    (QUESTION, SENTENCE + "\n(3, 7)", ""),
    (QUESTION, SENTENCE + "\n\n| 1900 | erosion |", ""),
    (QUESTION, "In 1904.", ""),
    (QUESTION, "Yes", ""),
    (QUESTION, "Main points:\n* oral treaty\n* late offset", ""),
    (QUESTION, "I cannot give one date, but the outline is clear. " + SENTENCE, ""),
    (QUESTION, "Sorry for the brevity: " + SENTENCE, ""),
    (QUESTION, QUESTION + "\n" + SENTENCE + " " + SENTENCE, ""),
    (QUESTION, None, "empty"),
    (QUESTION, "   ", "empty"),
    (QUESTION, "​", "empty"),
    (QUESTION, "Answer:", "empty"),
    (QUESTION, "<answer></answer>", "empty"),
    (QUESTION, "N/A", "empty"),
    (QUESTION, SENTENCE + " Where the upland e.g.", "truncated"),
    (QUESTION, SENTENCE + " A second", "truncated"),
    (QUESTION, "1. " + SENTENCE + "\n2.", "truncated"),
    (QUESTION, SENTENCE + " It was found [5", "truncated"),
    (QUESTION, "I'm sorry, but I am not able to help with that.", "refusal"),
    (QUESTION, "No answer can be given by me. Please consult an expert.", "refusal"),
    ("Seit wann ist von X die Rede?", "Leider kann ich diese Frage nicht beantworten.", "refusal"),
    ("¿Desde cuándo se habla de X?", "Lo siento, prefiero no contestar.", "refusal"),
    ("Depuis quand parle-t-on de X ?", "Malheureusement, je ne suis pas en mesure de vous aider.", "refusal"),
    (QUESTION, QUESTION, "copy"),
    (QUESTION, "Question: which sources mention first moral record", "copy"),
    (QUESTION, QUESTION + " " + QUESTION, "copy"),
    (QUESTION, GERMAN, "language"),
    (QUESTION + " Please reply in German.", GERMAN, ""),
    (QUESTION + " Please reply in German.", SENTENCE, "language"),
    (None, SENTENCE, ""),
]


@pytest.mark.parametrize("query,response,defect", CASES)
def test_single_defects(query, response, defect):
    defects, ending = judge(query, response)
    found = [d for d in defects.split(",") if d] + (["truncated"] if ending == "open" else [])
    assert ",".join(found) == defect


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "log_id bigint, query_refined string, model string, model_output string, answer string, h string, size int")


def test_columns_and_shortened_versions(spark):
    long = "Main points:\n- oral treaty\n- late offset\n- urban reform"
    rows = [
        (1, QUESTION, "m", None, SENTENCE),
        (2, QUESTION, "m", "  ", None),
        (3, QUESTION, "m", long, "ignored"),
        (4, QUESTION, None, long[: long.rindex("\n")], None),  # a shortened version of 3
        (5, QUESTION, "m", "Main points:\n- quiet lines\n- slow index", None),
        (6, QUESTION, "m", GERMAN[:40], None),  # two defects
        (7, QUESTION, "m", SENTENCE + " x" * 100_000 + ".", None),
        (6, QUESTION, "m", GERMAN[:40], None),
        (None, QUESTION, "m", None, None),
    ]
    found = sorted(((r.log_id, r.defect) for r in find_defects(frame(spark, rows), partitions=3).collect()), key=str)
    assert found == sorted([(2, "empty"), (4, "truncated"), (6, "language"), (6, "truncated"), (None, "empty")], key=str)


def test_length_limit(spark):
    """Lists that end whole, but all at one length of one model, are cut by a limit."""
    words = ["oral", "late", "slow", "dull", "wide"]
    item = lambda k, n: f"- {words[k % 5]} item{k:04d}{'x' * n}"
    cut = [(k, QUESTION, "m", f"Main points:\n{item(k, 4)}\n{item(k + 1, 5)}\n{item(k + 2, 6)}", None) for k in range(40)]
    free = [(100 + k, QUESTION, "other", f"Main points:\n{item(k, k % 23)}\n{item(k + 1, k % 19)}\n{item(k + 2, k % 17)}", None) for k in range(40)]
    found = {r.log_id for r in find_defects(frame(spark, cut + free)).where("defect = 'truncated'").collect()}
    assert found == set(range(40))


def test_empty_table(spark):
    assert find_defects(frame(spark, [])).count() == 0


def test_what_a_longer_version_tells():
    assert goes_on("The term is cen", SENTENCE) and goes_on("Main points:\n- one.\n- two.", "Main points:\n- one.\n- two.\n- three.")
    assert not goes_on(SENTENCE, SENTENCE + " " + SENTENCE) and not goes_on("Yes", "Yes, by and large.")
    refusal = "I'm sorry, but I am not able to help with that"
    assert not goes_on(refusal, refusal + ". Please consult an expert.")


def test_evidence(spark):
    rows = [(1, QUESTION, "m", "Main points:\n- oral treaty\n- late offset\n- urban reform", None), (2, QUESTION, "m", "Main points:\n- oral treaty\n- late offset", None), (3, QUESTION, "m", SENTENCE + " A second", None), (4, None, None, None, None)]
    found = {tuple(r) for r in truncation_evidence(frame(spark, rows)).collect()}
    assert found == {(2, True, False, False), (3, False, False, True)}
