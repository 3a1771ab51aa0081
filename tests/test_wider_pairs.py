"""Preorders of states of different enabled labels."""

from tracewise.plans.equivalence import LTS
from tracewise.sources import lts


def test_a_state_of_fewer_labels_is_simulated(spark):
    # 0 does a; 1 does a or b; 2 does a and then c; 3 does c alone
    system = LTS(lts.from_edges(spark, [(0, 9, 0), (1, 9, 0), (1, 9, 1), (2, 3, 0), (3, 9, 2)]), sparse=True)
    solved = system.equivalences()
    below = {(r.p, r.q) for r in solved.below("simulation").collect()}
    assert below == {(0, 1), (0, 2), (9, 0), (9, 1), (9, 2), (9, 3)}
    assert {(r.p, r.q) for r in solved.preorders("simulation").collect()} == {(0, 2)}
    assert {(r.p, r.q) for r in solved.below("readiness").collect()} == set()
