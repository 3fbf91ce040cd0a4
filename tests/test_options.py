"""Which wishes go together."""

from __future__ import annotations

import pytest

from tessella.options import DecodeOptions, TrainOptions


@pytest.mark.parametrize(
    "wrong",
    [
        {"model": "x"}, {"whitening": "x"}, {"frequent_words": "f", "word_vectors": "v"}, {"concat": True, "word_vectors": "v"}, {"hold_out": 0.1, "shrinkage": 0.1, "model": "glm"},
        {"shrinkage": 0.1}, {"unknown_pairs": True}, {"model": "sg"}, {"source_channel": True, "top_targets": 3}, {"source_channel": True, "lm_scores": ("a", "b")},
    ],
)
def test_contradictions_are_refused(wrong):
    with pytest.raises(ValueError):
        TrainOptions(**wrong).checked()


@pytest.mark.parametrize(
    ("given", "name", "off"),
    [
        ({"label_dependent": True}, "label_dependent", False),
        ({"uniform_cost": True, "model": "glm"}, "uniform_cost", False),
        ({"matching": 8, "model": "glm"}, "matching", 0),
        ({"matching": 8, "relative_frequencies": True}, "relative_frequencies", False),
        ({"hard_rows_only": True, "lm_scores": ("a", "b")}, "hard_rows_only", False),
        ({"hard_rows_only": True, "matching": 8}, "hard_rows_only", False),
    ],
)
def test_wishes_without_effect_are_dropped(given, name, off):
    with pytest.warns(UserWarning, match=name):
        assert getattr(TrainOptions(**given).checked(), name) == off


def test_decoding():
    for given, name, off in (({"normalise": "x"}, "normalise", "none"), ({"discretise": True}, "discretise", False), ({"second_order": True}, "second_order", False), ({"log": True}, "log", False)):
        with pytest.warns(UserWarning, match=name):
            assert getattr(DecodeOptions(**given).checked(), name) == off
    fine = DecodeOptions(log=True, only_positive=True, representations=True, second_order=True)
    assert fine.checked() == fine and TrainOptions(whitening="ppmi").checked().second_whitening == "full"
