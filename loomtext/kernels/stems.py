"""Stemmers that work word by word: Lancaster, Snowball's English, German and Scandinavian ones, two Arabic light stemmers."""

from __future__ import annotations

import re
from collections.abc import Callable

# ---------------------------------------------------------------- Lancaster (Paice and Husk, 1990)

#: The published rule table: reversed ending, * for words that are still whole, letters to drop, letters to add, > to go on.
_LANCASTER = """ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2.
hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y.
luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2.
ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1.
tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3>
ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."""
_RULE = re.compile(r"([a-z]+)(\*?)(\d)([a-z]*)([.>])")
_UNITS = ("kilo", "micro", "milli", "intra", "ultra", "mega", "nano", "pico", "pseudo")


def _lancaster_rules() -> dict[str, list[tuple[str, bool, int, str, bool]]]:
    rules: dict[str, list] = {}
    for end, whole, drop, add, more in _RULE.findall(_LANCASTER):
        rules.setdefault(end[0], []).append((end[::-1], bool(whole), int(drop), add, more == ">"))
    return rules


_BY_LETTER = _lancaster_rules()


def lancaster(word: str) -> str:
    """M2. Rules by last letter; a result needs two letters if it begins with a vowel, else three."""
    w = word.lower()
    if len(w) <= 1:
        return w
    w = next((w[len(p) :] for p in _UNITS if w.startswith(p) and len(w) > len(p) + 1), w)
    first, going = w, True
    while going:
        going = False
        last = next((i for i, c in enumerate(w) if not c.isalpha()), len(w))
        for end, whole, drop, add, more in _BY_LETTER.get(w[last - 1], ()) if last else ():
            if not w[:last].endswith(end) or (whole and w != first):
                continue
            stem = w[: len(w) - drop] + add
            if len(stem) < (2 if stem[:1] in ("a", "e", "i", "o", "u") else 3):
                continue
            w, going = stem, more
            break
    return w


# ---------------------------------------------------------------- Snowball


def _regions(w: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first non-vowel that follows a vowel, and again from there."""

    def after(start: int) -> int:
        m = re.compile(f"[{vowels}][^{vowels}]").search(w, start)
        return m.end() if m else len(w)

    r1 = after(0)
    return r1, after(r1)


def _longest(w: str, ends: str | tuple[str, ...]) -> str:
    return max((e for e in (ends.split() if isinstance(ends, str) else ends) if w.endswith(e)), key=len, default="")


_EN_WHOLE = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
    "dying": "die", "lying": "lie", "tying": "tie",
}
_EN_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_V = "aeiouy"


def _english(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    if w in _EN_WHOLE:
        return _EN_WHOLE[w]
    w = w.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else _regions(w, _EN_V)[0]
    m = re.compile(f"[{_EN_V}][^{_EN_V}]").search(w, r1)
    r2 = m.end() if m else len(w)

    def short(x: str) -> bool:
        return bool(re.search(f"[^{_EN_V}][{_EN_V}][^{_EN_V}wxY]$|^[{_EN_V}][^{_EN_V}]$", x)) and r1 >= len(x)

    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_EN_V}].+$", w[:-1]):
        w = w[:-1]
    if w in _EN_KEEP:
        return w
    e = _longest(w, "eed eedly ed edly ing ingly")
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and re.search(f"[{_EN_V}]", w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_V:
        w = w[:-1] + "i"
    e = _longest(w, (*_EN_2, "ogi", "li"))
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif e == "li":
            w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
        else:
            w = w[: -len(e)] + _EN_2[e]
    e = _longest(w, (*_EN_3, "ative"))
    if e and len(w) - len(e) >= r1:
        if e != "ative":
            w = w[: -len(e)] + _EN_3[e]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    e = _longest(w, "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not re.search(f"[^{_EN_V}][{_EN_V}][^{_EN_V}wxY]$|^[{_EN_V}][^{_EN_V}]$", w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{v}])u(?=[{v}])", "U", w)
    w = re.sub(f"(?<=[{v}])y(?=[{v}])", "Y", w)
    r1, r2 = _regions(w, v)
    r1 = max(r1, 3) if r1 < len(w) else r1
    e = _longest(w, "em ern er e en es s")
    if e and len(w) - len(e) >= r1 and (e != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(e)]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    e = _longest(w, "en er est st")
    if e and len(w) - len(e) >= r1 and (e != "st" or (w[-3:-2] in tuple("bdfghklmnt") and len(w) >= 6)):
        w = w[: -len(e)]
    e = _longest(w, "end ung ig ik isch lich heit keit")
    if e and len(w) - len(e) >= r2:
        stem = w[: -len(e)]
        if e in ("end", "ung"):
            w = stem
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif e in ("lich", "heit"):
            w = stem
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = stem
            for x in ("lich", "ig"):
                if w.endswith(x) and len(w) - len(x) >= r2:
                    w = w[: -len(x)]
                    break
    return w.translate(str.maketrans("UYäöü", "uyaou"))


_SV = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast"


def _swedish(w: str) -> str:
    v = "aeiouyäåö"
    r1 = max(3, _regions(w, v)[0])
    e = _longest(w[r1:], _SV)
    if e:
        w = w[: -len(e)]
    elif len(w) > r1 and w.endswith("s") and w[-2:-1] in tuple("bcdfghjklmnoprtvy"):
        w = w[:-1]
    if _longest(w[r1:], "dd gd nn dt gt kt tt"):
        w = w[:-1]
    e = _longest(w[r1:], "lig ig els löst fullt")
    return w[:-1] if e in ("löst", "fullt") else w[: len(w) - len(e)]


_NO = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast"


def _norwegian(w: str) -> str:
    v = "aeiouyæåø"
    r1 = max(3, _regions(w, v)[0])
    e = _longest(w[r1:], (*_NO.split(), "erte", "ert"))
    if e in ("erte", "ert"):
        w = w[: -len(e)] + "er"
    elif e:
        w = w[: -len(e)]
    elif len(w) > r1 and w.endswith("s") and (w[-2:-1] in tuple("bcdfghjlmnoprtvyz") or re.search(f"[^{v}]ks$", w)):
        w = w[:-1]
    if _longest(w[r1:], "dt vt"):
        w = w[:-1]
    e = _longest(w[r1:], "leg eleg ig eig lig elig els lov elov slov hetslov")
    return w[: len(w) - len(e)]


_DA = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret"


def _danish(w: str) -> str:
    v = "aeiouyæåø"
    r1 = max(3, _regions(w, v)[0])

    def double(x: str) -> str:
        return x[:-1] if _longest(x[r1:], "gd dt gt kt") else x

    e = _longest(w[r1:], _DA)
    if e:
        w = w[: -len(e)]
    elif len(w) > r1 and w.endswith("s") and w[-2:-1] in tuple("abcdfghjklmnoprtvyzå"):
        w = w[:-1]
    w = double(w)
    if w.endswith("igst"):
        w = w[:-2]
    e = _longest(w[r1:], "ig lig elig els løst")
    if e == "løst":
        w = w[:-1]
    elif e:
        w = double(w[: -len(e)])
    if len(w) > r1 and re.search(f"([^{v}])\\1$", w):
        w = w[:-1]
    return w


SNOWBALL: dict[str, Callable[[str], str]] = {}
for _names, _f in (("english en", _english), ("german de", _german), ("swedish sv", _swedish), ("norwegian no", _norwegian), ("danish da", _danish)):
    SNOWBALL |= dict.fromkeys(_names.split(), _f)


def snowball(language: str) -> Callable[[str], str]:
    """M3: by name or ISO code, whatever its case; an unknown language raises."""
    if language.lower() not in SNOWBALL:
        raise ValueError(f"no Snowball stemmer of {language!r}")
    stem = SNOWBALL[language.lower()]
    return lambda word: stem(word.lower())


# ---------------------------------------------------------------- Arabic light stemmers

_MARKS = re.compile("[ً-ْٰ]")
_LETTERS = str.maketrans("آأإىة", "ااايه")
# affixes in Buckwalter's transliteration, in the order in which they are tried
_TO_ARABIC = str.maketrans("AbtvjHxd*rzs$SDTZEgfqklmnhwyp>", "ابتثجحخدذرزسشصضطظعغفقكلمنهويةأ")


def _arabic(forms: str) -> list[str]:
    return forms.translate(_TO_ARABIC).split()


_AR_PRE = _arabic("Al wbAl fbAl bAl wll ll fswf swf fAl wswf wAl wb fl wsy fsy ws fs ly l f w s b")
_AR_SUF = _arabic("kmA hmA km hm hn kn wn yn An wA hA nA tm tn tA h n A y t p k")
_AR_PLURAL = _arabic("At yn wn An")
_AR_VERB = (_arabic("sy s f y t A n >"), _arabic("wn yn An wA n A y t tm tn nA"))
_AR_VERB2 = (_arabic("f w b l s y t A n > sy"), _arabic("wn yn An wA n A y t tA tm tn nA kmA hm hn kn"))


def _without_suffix(w: str, suffixes: list[str]) -> str | None:
    return next((w[: -len(x)] for x in suffixes if w.endswith(x) and len(w) > len(x) + 1), None)


def arlstem(word: str, second: bool = False) -> str:
    """M10; second: M11, with more verb affixes. Marks go, then a prefix, a suffix, and a plural, or of words without a prefix a
    verb's affixes."""
    w = _MARKS.sub("", word).translate(_LETTERS)
    cut = next((w[len(x) :] for x in _AR_PRE if w.startswith(x) and len(w) > len(x) + 1), None)
    w = w if cut is None else cut
    w = _without_suffix(w, _AR_SUF) or w
    single = _without_suffix(w, _AR_PLURAL)
    if single is not None and len(single) >= 2:
        return single
    if len(w) in (4, 5) and w[1] == "ا":
        return w[0] + w[2:]
    if cut is not None:
        return w
    before, behind = _AR_VERB2 if second else _AR_VERB
    w = next((w[len(x) :] for x in before if w.startswith(x) and len(w) > len(x) + 2), w)
    return _without_suffix(w, behind) or w
