"""How often the decoder of op2 searches, and that the short way through a lattice gives what the long one does."""

import numpy as np

from rosterline.llm import toxicity


def test_tokens_without_a_run_are_searched_once(monkeypatch):
    calls = []
    plain = toxicity.viterbi
    monkeypatch.setattr(toxicity, "viterbi", lambda slots, model: (calls.append(1), plain(slots, model))[1])
    reader = toxicity.Restorer(np.log(np.random.default_rng(1).dirichlet(np.ones(toxicity.SIZE), size=(toxicity.SIZE, toxicity.SIZE))))
    reader.readings("1d10t")
    assert len(calls) == 1
    reader.readings("id100t")
    assert len(calls) == 3


def test_lattice_of_runs_is_that_of_single_characters():
    for chars in ("1d10t", "aaa", "a--b", "idddiooot", "$$$", "é..éé"):
        for costs in toxicity.REPEATS:
            spaced = toxicity.lattice(chars, costs, spaced=True)
            assert toxicity.lattice(chars, costs) == spaced[::2]
