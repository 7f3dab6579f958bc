import math
import random

from complexa.llm import secrets as S

BOUND = math.sqrt(0.5 * math.log(2 / S.ALPHA))
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="


def test_every_pair_that_can_disagree_is_tested():
    rng = random.Random(6)
    # equal trees of many states below each symbol, but below one where the two sides always differ
    noise = [s + "".join(rng.choice("ab") for _ in range(60)) for s in SYMBOLS[1:] for _ in range(15)]
    tree = S.Automaton()
    for side, after in (("x", "0"), ("y", "1")):
        for w in noise + ["a" + after + str(i) for i in range(100, 160)]:
            tree.add(side + w)
    x, y = tree.out[0]["x"][1], tree.out[0]["y"][1]
    assert not S._compatible(tree, x, y, BOUND)


def test_whole_values_are_learned():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (40, 64, 65, 130, 2000) for _ in range(40)})
    model = S.learn(words)
    assert sum(model.ends) == len(words) and sum(n for out in model.out for n, _ in out.values()) == sum(map(len, words))
    for seen, ends, out in zip(model.seen, model.ends, model.out):
        assert seen == ends + sum(n for n, _ in out.values())
