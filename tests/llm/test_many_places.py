from cinderbase.llm import leaks

VALUES = {"anna", "bern", "clara", "1871"}


def test_the_true_place_behind_many_of_the_same_template():
    sentence = "the great battle of anna was fought in 1871 by bern near the river clara".split()
    decoys = " ".join(f"the great battle of p{i} was fought in 19{i:02} by q{i} near the river r{i} stop" for i in range(8))
    true = "the large fight of anna were waged in 1871 by bern beside the river clara"

    def code(w):
        return leaks.NUMBER if w.isdigit() else leaks.NAME if w in VALUES or w[0] in "pqr" and w[1:].isdigit() else leaks.UNIT + 1

    assert leaks.held_share([sentence], (decoys + " " + true).split(), code) >= 0.6
    assert leaks.held_share([sentence], decoys.split(), code) == 0
