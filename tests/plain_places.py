"""Plain forms of place names in free text, to hold the library against."""

import re
import unicodedata
from functools import lru_cache

from gridlore import constants as C


@lru_cache(maxsize=100_000)
def fold_text(text: str) -> str:
    """``fold_key`` on a plain text."""
    low = text.translate({0x130: "i", 0x49: "i", 0x131: "i"}).lower()
    bare = "".join(c for c in unicodedata.normalize("NFD", low) if not 0x300 <= ord(c) <= 0x36F)
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare).split())


def words_of(text: str) -> list[str]:
    edge = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    bare = re.sub("['’´`][a-zçğıöşüA-ZÇĞİÖŞÜ]{1,6}" + edge, "", text)
    return [w for w in re.split("[^0-9A-Za-zÇĞİıÖŞÜçğöşü]+", bare) if w]


def alike(a: str, b: str, threshold: float) -> float:
    """Similarity, or 0 where it is below the threshold."""
    longest = max(len(a), len(b))
    most = int(longest * (1 - threshold) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return 0.0
    return 1 - row[-1] / longest if row[-1] <= most else 0.0


class Plain:
    """Place names of a test, every word against every spelling."""

    def __init__(self, places: list[tuple[str, str, list[str], int]]):
        spelled = [(fold_text(s), n, d) for n, d, more, _ in sorted(places, key=lambda p: p[3]) for s in (n, *more)]
        self.spellings = [s for s in spelled if s[0]]
        self.by_key = {}
        for key, name, district in sorted(self.spellings, key=lambda s: -len(s[1])):
            self.by_key.setdefault(key, (name, district))
        self.most_words = max((len(p[0].split()) for p in places), default=0)

    def match(self, text: str) -> list[tuple[str, str, bool, str]]:
        """(name, district, fuzzy, words) of the places in a text: from each capital the longest known run of
        words, else a word that is nearly a spelling."""
        words, found, at = words_of(text), {}, 0
        capital = lambda w: w[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZÇĞİÖŞÜ"
        while at < len(words):
            took = 1
            if capital(words[at]):
                for n in range(min(self.most_words, len(words) - at), 0, -1):
                    said = " ".join(words[at : at + n])
                    if place := self.by_key.get(fold_text(said)):
                        found.setdefault(place[0], (*place, False, said))
                        took = n
                        break
                else:
                    key = fold_text(words[at])
                    if len(key) >= C.MIN_FUZZY_LENGTH:
                        score, name, district = max(
                            ((alike(key, k, C.FUZZY_THRESHOLD), n, d) for k, n, d in self.spellings), key=lambda x: x[0], default=(0.0, "", "")
                        )
                        if score >= C.FUZZY_THRESHOLD:
                            found.setdefault(name, (name, district, True, words[at]))
            at += took
        return list(found.values())

    def match_areas(self, areas: list[str]) -> list[tuple[str, str, bool, str]]:
        """Places of a list of names. A name that is none is read together with its neighbour, the left one
        first, where the two say more than the neighbour alone."""
        alone = [self.match(a) for a in areas]
        joined: dict[int, list] = {}
        for i in range(len(areas)):
            if alone[i]:
                continue
            for j in (i - 1, i + 1):
                if 0 <= j < len(areas):
                    both = self.match(f"{areas[min(i, j)]} {areas[max(i, j)]}")
                    if both and not {m[0] for m in both} <= {m[0] for m in alone[j]}:
                        joined[i], joined[j] = both, []
                        break
        found = {}
        for i in range(len(areas)):
            for m in joined.get(i, alone[i]):
                found.setdefault(m[0], m)
        return list(found.values())
