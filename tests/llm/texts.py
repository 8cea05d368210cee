"""Small invented prose for the tests of this folder."""

import random

WORDS = {
    "en": "the of and that in is was for with thing other house little water over under morning people river".split(),
    "fr": "les des une dans pour avec été maison petite eau après matin gens rivière être même où déjà".split(),
}


def prose(seed: int, n: int, lang: str = "en") -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS[lang]) for _ in range(n))
