"""What a training or decoding run may be asked for, and which wishes go together."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

#: The learners, whitenings and normalisations there are.
MODELS = ("cca", "glm", "mlr", "mlp", "svm", "sg")
WHITENINGS = ("identity", "full", "diag", "ppmi")
NORMALISATIONS = ("none", "exp", "range")


def _drop(options, name: str, off, why: str):
    warnings.warn(f"{name} is ignored: {why}", stacklevel=3)
    return replace(options, **{name: off})


@dataclass(frozen=True)
class TrainOptions:
    """Contexts, vocabularies, learner and evaluation of one training run; ``checked`` applies the rules between them."""

    context_length: int = 2
    ranks: tuple[int, int] = (100, 50)
    gammas: tuple[float, float] = (1.0, 1.0)
    position: bool = False
    concat: bool = False
    frequent_words: str | None = None
    stop_words: str | None = None
    word_vectors: str | None = None
    #: targets kept per source; 0 keeps all
    top_targets: int = 0
    context_cutoff: int = 1
    pair_cutoff: int = 0
    unknown_pairs: bool = False
    model: str = "cca"
    whitening: str = "full"
    centre: bool = False
    hold_out: float = 0.0
    shrinkage: float = 0.0
    label_dependent: bool = False
    uniform_cost: bool = False
    sparse_features: bool = False
    #: hidden units of the matching network; 0 is none
    matching: int = 0
    relative_frequencies: bool = False
    hard_rows_only: bool = False
    lm_scores: tuple[str, str] | None = None
    skipgram: tuple[str, str] | None = None
    source_channel: bool = False

    def checked(self) -> TrainOptions:
        """The options as they take effect. What contradicts itself raises ``ValueError``, what has no effect is dropped with a warning."""
        refused = [
            (self.model not in MODELS, f"model must be one of {MODELS}"),
            (self.whitening not in WHITENINGS, f"whitening must be one of {WHITENINGS}"),
            (bool(self.frequent_words and self.word_vectors), "a list of frequent words doesn't go with word vectors"),
            (bool(self.concat and self.word_vectors), "concatenated contexts don't go with word vectors; use positions"),
            (self.hold_out > 0 and self.shrinkage > 0, "held-out rows are needed for shrinkage or for evaluation, not both"),
            (self.shrinkage > 0 and self.model != "glm", "shrinkage needs the model glm"),
            (self.unknown_pairs and self.pair_cutoff == 0, "unknown pairs need a pair cutoff above 0"),
            (self.model == "sg" and self.skipgram is None, "the model sg needs skip-gram vectors"),
            (self.source_channel and self.lm_scores is None, "the source channel needs language model scores"),
            (self.source_channel and self.top_targets == 0, "the source channel needs counts, which come with top_targets"),
        ]
        for wrong, why in refused:
            if wrong:
                raise ValueError(why)
        out = self
        for name in ("label_dependent", "uniform_cost", "sparse_features"):
            if getattr(out, name) and out.model != "mlr":
                out = _drop(out, name, False, "it belongs to the model mlr")
        if out.matching and out.model != "cca":
            out = _drop(out, "matching", 0, "it belongs to the model cca")
        if out.relative_frequencies and out.top_targets == 0 and (out.matching or out.source_channel):
            out = _drop(out, "relative_frequencies", False, "without top_targets there are no counts")
        if out.hard_rows_only and not out.matching:
            out = _drop(out, "hard_rows_only", False, "it belongs to the matching network")
        if out.hard_rows_only and out.lm_scores is None:
            out = _drop(out, "hard_rows_only", False, "there are no language model scores")
        return out

    @property
    def second_whitening(self) -> str:
        """Of the second CCA step: after ppmi it whitens fully."""
        return "full" if self.whitening == "ppmi" else self.whitening


@dataclass(frozen=True)
class DecodeOptions:
    """How scores and representations are printed with the rules of a grammar."""

    normalise: str = "none"
    representations: bool = False
    discretise: bool = False
    second_order: bool = False
    plain: bool = False
    flags: bool = True
    log: bool = False
    only_positive: bool = False
    best: bool = False
    rank: bool = False
    logistic: bool = False

    def checked(self) -> DecodeOptions:
        """The options as they take effect; what can't take effect is dropped with a warning."""
        out = self
        if out.normalise not in NORMALISATIONS:
            out = _drop(out, "normalise", "none", f"it must be one of {NORMALISATIONS}")
        for name in ("discretise", "second_order"):
            if getattr(out, name) and not out.representations:
                out = _drop(out, name, False, "representations aren't printed")
        if out.log and not out.only_positive:
            out = _drop(out, "log", False, "scores may be negative")
        return out
