import numpy as np

from shorewise.llm import substrings as S
from shorewise.llm.winnow import anchors, anchors_of


def test_anchors_of_several_widths_against_plain_code():
    grams = np.random.default_rng(4).integers(0, 2**64, 700, dtype=np.uint64) & ~np.uint64((1 << 26) - 1)
    grams[100:300] = grams[100]
    widths = [301, 1, 156, 4, 700, 701]
    for width, found in zip(widths, anchors_of(grams, widths), strict=True):
        plain = [max(range(a, a + width), key=lambda i: (-int(grams[i]), i)) for a in range(len(grams) - width + 1)]
        assert found.tolist() == plain == anchors(grams, width).tolist()


def test_powers_are_kept_and_cut_to_length():
    for n in (5, 3, 0, 9):
        assert S._powers(7, n).tolist() == [pow(7, k, 2**64) for k in range(n)]
