"""A clause is read whole, however long."""

from wayreach.llm import toxicity


def test_a_target_far_back_counts():
    model = toxicity.ToxicModel({"kill": ("H", 1.0, False)})
    said = lambda t: model.evidence(t, model.automaton())
    assert said("you " + "word " * 200 + "kill") == said("you kill") == 1.0
    assert said("you. " + "word " * 200 + "kill") == 0.25
