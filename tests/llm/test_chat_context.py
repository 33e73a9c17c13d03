"""Templates that look further back than the context they state are found, whatever they look for."""

import random

import pytest

from tidegauge.llm import chat_format as CF


def marked(messages):
    """In front stands whether any turn has been marked."""
    front = "seen|" if any(text == "mark" for _, text in messages) else "none|"
    return front + CF.turn_template(messages)


def forgetful(messages):
    """All before the last turn ``reset`` is forgotten."""
    at = max((i for i, (_, text) in enumerate(messages) if text == "reset"), default=0)
    return CF.turn_template(messages[at:])


def counted(messages):
    """At the end of each turn stands how many turns of its role there were: the turn at hand betrays it."""
    return "".join(f"{CF.turn_template([m])}{sum(r == m[0] for r, _ in messages[: i + 1])}" for i, m in enumerate(messages))


def turns(n, special=None, at=None):
    return [("user" if i % 2 == 0 else "assistant", special if i == at else f"text {i}") for i in range(n)]


@pytest.mark.parametrize("template, special", [(marked, "mark"), (forgetful, "reset")])
@pytest.mark.parametrize("at", [0, 7, 9, 50, 89])
def test_no_wrong_output_under_a_context(template, special, at):
    said = turns(91, special, at)
    whole = CF.render(said, template, None)
    assert whole[0] == template(said)
    try:
        got = CF.render(said, template, 4, check=True)
    except ValueError:
        return
    assert got[0] == whole[0]


def test_templates_of_the_verdict_are_refused():
    for template, special in ((marked, "mark"), (forgetful, "reset")):
        with pytest.raises(ValueError, match="context"):
            CF.render(turns(91, special, 50), template, 4, check=True)
        with pytest.raises(ValueError, match="context"):  # the end is checked too, long after the last doubling
            CF.render(turns(91, special, 80), template, 4, check=True)


def test_a_template_that_keeps_its_context_is_left_alone():
    pick = random.Random(3)
    for n in (0, 1, 7, 8, 9, 40, 300):
        said = [(pick.choice(("user", "assistant")), "x" * pick.randrange(30)) for _ in range(n)]
        assert CF.render(said, CF.turn_template, 4, check=True) == CF.render(said, CF.turn_template, None)
    # a count makes each span depend on all turns: whole prefixes go on from the start
    said = turns(60)
    assert CF.render(said, counted, 4, check=True)[0] == counted(said)


def test_checking_stays_linear():
    rendered = 0

    def measured(messages):
        nonlocal rendered
        rendered += len(messages)
        return CF.turn_template(messages)

    work = []
    for n in (1_000, 4_000):
        rendered = 0
        CF.render(turns(n), measured, 4, check=True)
        work.append(rendered / n)
    assert max(work) < 20 and work[1] < 1.2 * work[0] + 1


def test_frame_of_a_refused_template(spark):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns(91, "mark", 50))], "conv_id long, turn int, role string, text string")

    def local(messages):  # workers don't have this module
        return ("seen|" if any(text == "mark" for _, text in messages) else "none|") + CF.turn_template(messages)

    with pytest.raises(Exception, match="further back than its context"):
        CF.format_conversations(df, (local, 4)).collect()
    assert CF.format_conversations(df, (local, None)).first()["rewrites"] == [50]
