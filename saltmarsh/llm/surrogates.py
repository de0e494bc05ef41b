"""Keyed replacements of personal data, of the same type and format.

Numbers, addresses and secrets: each character is a digit of its own radix (decimal digits,
hexadecimal digits, letters of a script and case), the string is a number below the product of
the radices, and a Feistel network over that range, conjugated with a shift, maps it to another
one. So equal originals get equal surrogates anywhere in the corpus, different ones different
surrogates, and none itself, with nothing to look up or to gather. Check digits that are right
stay right, and wrong ones stay wrong by as much.

Names: those in a pool of their gender and script are permuted within it. All others are
numbered by script and length, permuted, and the number is spelled in syllables of the script
with an ending for the gender (or for a family name): one-to-one, as a number has one spelling.
Every entity is brought to one spelling (`canonical`) before it is permuted and gets its case
and punctuation back afterwards.
"""

from __future__ import annotations

import hashlib
import hmac
from functools import lru_cache

#: Given names by script and gender, and family names.
POOLS = {
    "latin": {
        "f": """Agnes Alice Amelie Andrea Angela Anna Anne Antonia Astrid Barbara Beatriz Birgit Brigitte Camille Carla Carmen Caroline Catherine Charlotte Chloe Christina Clara Claire
        Daniela Diana Dolores Elena Elisabeth Elise Elizabeth Emily Emma Erika Eva Frieda Gabriela Gertrud Greta Hannah Heidi Helen Helga Ida Ines Inge Ingrid Isabel Jane
        Jessica Johanna Juliette Karin Katharina Laura Lena Louise Lucia Maria Marie Marta Mary Monika Nadine Nina Olga Paula Petra Pilar Rosa Ruth Sabine Sandra Sara Sarah
        Silvia Simone Sofia Sophie Susan Teresa Ursula Vera Victoria Yvonne""".split(),
        "m": """Adam Alain Albert Alejandro Alexander Alfred Andreas Anton Antoine Arthur Bernard Bernd Bruno Carlos Charles Christian Christopher Daniel David Diego Dieter Edward Emil Enrique
        Ernst Felix Fernando Francisco Frank Franz Friedrich George Gerhard Guillaume Hans Harald Heinrich Henri Henry Hugo Ivan Jacques James Jan Javier Jean Joachim John Jorge Joseph
        Juan Julien Karl Klaus Laurent Leon Lorenz Louis Luc Luis Manuel Marcel Marco Martin Matthew Max Michael Michel Miguel Nicolas Oscar Otto Pablo Patrick Paul Pedro Peter
        Philip Pierre Ralf Ramon Richard Robert Rolf Rudolf Sebastian Simon Stefan Thomas Victor Walter William Wolfgang Xavier""".split(),
        "family": """Adams Alvarez Bailey Baker Bauer Becker Bennett Bernard Blanc Braun Brown Campbell Carter Castro Clark Collins Cooper Cruz Davis Delgado Diaz Dubois Dupont Durand Edwards
        Evans Fischer Fontaine Fournier Garcia Girard Gomez Gonzalez Gray Green Hall Harris Hartmann Hernandez Hill Hoffmann Hughes Jackson Johnson Jones Keller Koch Lambert Lang Lefebvre
        Leroy Lewis Lopez Martinez Mayer Meyer Miller Mitchell Moore Morales Moreau Morris Navarro Neumann Ortega Parker Perez Petit Phillips Ramirez Richter Rivera Roberts Robinson
        Romero Roux Ruiz Sanchez Schmidt Schneider Schulz Scott Smith Taylor Thompson Torres Turner Vogel Wagner Walker Weber White Wilson Wright Young Zimmermann""".split(),
    },
    "cyrillic": {
        "f": "Алла Анна Вера Галина Дарья Елена Ирина Лариса Мария Нина Ольга Полина Светлана София Татьяна Юлия".split(),
        "m": "Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Максим Михаил Николай Олег Павел Роман Сергей Юрий".split(),
        "family": "Мельник Шевченко Коваль Бондарь Гончар Кравец Ткач Лысенко".split(),
    },
    "greek": {
        "f": "Άννα Ελένη Ειρήνη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
        "m": "Ανδρέας Γιώργος Δημήτρης Ιωάννης Κώστας Νίκος Παύλος Σπύρος".split(),
        "family": "Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παππάς Χρήστου".split(),
    },
}
#: Letters of each script, first the plain ones.
LETTERS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿāăąćčďđēęěğīłńňőœřśşšťůűźżžșț"),
    "cyrillic": ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "ёіїєґўјљњћџђ"),
    "greek": ("αβγδεζηθικλμνξοπρςστυφχψω", "άέήίόύώϊϋΐΰ"),
}
#: What syllables are made of (one consonant, one vowel, one or no consonant) and what ends a name of each role.
SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", ["", "l", "m", "n", "r", "s"]),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", ["", "л", "м", "н", "р", "с"]),
    "greek": ("βγδκλμνπρστφ", "αεηιο", ["", "λ", "ν", "ρ", "σ"]),
}
ENDINGS = {
    "latin": {"f": "lia", "m": "rik", "n": "ri", "family": "sen"},
    "cyrillic": {"f": "лия", "m": "рик", "n": "ри", "family": "тко", "family-m": "нов", "family-f": "нова"},
    "greek": {"f": "λια", "m": "ρικος", "n": "ρι", "family": "ραθ"},
}
#: What family names with a form for each gender end in.
INFLECTED = {"family-m": ("ов", "ев", "ин"), "family-f": ("ова", "ева", "ина")}
ROLES = ("f", "m", "n", "family")
#: Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

ALPHABETS = ["0123456789", *(f(x) for x in ("aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäéèêëíìîïóòôöúùûü", "ñçšžłřčď", "ãåæõøýþð", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя") for f in (str, str.upper))]
_HEX = ["0123456789abcdef", "0123456789ABCDEF"]
_PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}


def _mix(key: bytes, n: int, tweak: str, x: int, back: bool) -> int:
    """Balanced Feistel network over numbers of an even count of bits, repeated until the result is below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    size = (half + 7) // 8
    while True:
        a, b = x >> half, x & low
        for r in range(7, -1, -1) if back else range(8):
            if back:
                a, b = b ^ _round(key, tweak, r, a, size) & low, a
            else:
                a, b = b, a ^ _round(key, tweak, r, b, size) & low
        x = a << half | b
        if x < n:
            return x


def _round(key: bytes, tweak: str, r: int, x: int, size: int) -> int:
    data = tweak.encode() + bytes([0, r]) + x.to_bytes(size, "big")
    return int.from_bytes(hashlib.shake_256(key + data).digest(size), "big") if size > 32 else int.from_bytes(hmac.digest(key, data, "sha256")[:size], "big")


def permute(key: bytes, n: int, tweak: str, x: int) -> int:
    """A keyed permutation of 0..n-1 without a fixed point (n at least 2)."""
    if n < 2:
        return x
    return _mix(key, n, tweak, (_mix(key, n, tweak, x, True) + 1) % n, False)


def reshape(key: bytes, tweak: str, text: str, alphabets: dict[str, tuple[str, int]] = _PLACE) -> str:
    """A string of the same format: each character of a known alphabet is replaced from it, others stay."""
    places = [(i, *alphabets[c]) for i, c in enumerate(text) if c in alphabets]
    x, n = 0, 1
    for _, alphabet, digit in places:
        x, n = x * len(alphabet) + digit, n * len(alphabet)
    shape = tweak + "|" + "".join(alphabets[c][0][0] if c in alphabets else c for c in text)
    x, out = permute(key, n, shape, x), list(text)
    for i, alphabet, _ in reversed(places):
        x, digit = divmod(x, len(alphabet))
        out[i] = alphabet[digit]
    return "".join(out)


# --- canonical spellings


def folded(text: str) -> str:
    """Small letters, one for each character."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _cased(old: str, new: str) -> str:
    return "".join(b.upper() if a.isupper() and len(b.upper()) == 1 else b for a, b in zip(old, new))


def _digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def canonical(kind: str, text: str) -> str:
    """What the spellings of one entity have in common: digits of a number, with a plus if it has a country
    code; a bank code without blanks; small letters, but for secrets. Of family names with a form for each
    gender it is the masculine one."""
    if kind in ("account", "id"):
        return _digits_of(text)
    if kind == "phone":
        return "+" * text.startswith("+") + _digits_of(text)
    if kind == "iban":
        return text.replace(" ", "").upper()
    if kind == "secret":
        return text
    small = folded(text)
    return small[:-1] if kind == "family" and _inflection(small) == "family-f" else small


def replaceable(kind: str, text: str) -> bool:
    """Whether a key can change it: not a form's blank, not digits of other scripts only."""
    if kind in ROLES:
        return all(script_of(p) for p in _parts(text)[::2])
    if kind == "phone":
        text = canonical(kind, text)[len(country_code(canonical(kind, text))) :]
    return any(c in _PLACE for c in (text[4:] if kind == "iban" else text.rpartition(".")[0] if kind == "email" else text))


def country_code(number: str) -> str:
    """Plus and country code of a number in its canonical spelling; nothing where it has none."""
    if not number.startswith("+"):
        return ""
    return number[:2] if number[1:2] in ("1", "7") else number[:3] if number[1:3] in TWO_DIGITS else number[:4]


# --- numbers


def luhn(digits: str) -> bool:
    return _luhn_rest(digits) == 0


def _luhn_rest(digits: str) -> int:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _account(key: bytes, digits: str) -> str:
    """All digits but the last are permuted; the last one is right if it was, else wrong by as much."""
    head = reshape(key, f"account{len(digits)}", digits[:-1])
    return head + str((_luhn_rest(digits) - _luhn_rest(head + "0")) % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(key: bytes, code: str) -> str:
    """Country and length stay; check digits are right if they were, else wrong by as much."""
    land, check, body = code[:2], code[2:4], code[4:]
    new = reshape(key, f"iban{land}", body)
    if not 2 <= int(check) <= 98:  # never right
        return land + check + new
    wrong = (int(check) - (98 - _mod97(body + land + "00"))) % 97
    return land + f"{(98 - _mod97(new + land + '00') + wrong - 2) % 97 + 2:02d}" + new


def _respelled(old: str, fresh: str, mine) -> str:
    """The characters of `old` for which `mine` holds are replaced in turn by those of `fresh`."""
    left = iter(fresh)
    return "".join(next(left) if mine(c) else c for c in old)


# --- names


def script_of(name: str) -> str | None:
    """The script in which all letters of a name are, or None."""
    small = folded(name)
    return next((s for s, (plain, more) in LETTERS.items() if small and all(c in plain or c in more for c in small)), None)


_POOLED = {(script, role): {folded(n): i for i, n in enumerate(names)} for script, of in POOLS.items() for role, names in of.items()}
#: Genders by given name, of those that only one gender has.
GENDER = {n: g for script in POOLS for g, other in ("fm", "mf") for n in _POOLED[script, g] if n not in _POOLED[script, other]}


def _parts(name: str) -> list[str]:
    """Parts of a name and, at odd places, what joins them."""
    out = [""]
    for c in name:
        if c in "-'’ ":
            out += [c, ""]
        else:
            out[-1] += c
    return out


def _inflection(small: str) -> str | None:
    return next((role for role in ("family-f", "family-m") if len(small) > 4 and small.endswith(INFLECTED[role]) and script_of(small) == "cyrillic"), None)


def _spelled(script: str, number: int, ending: str) -> str:
    """Two or more syllables for a number, and an ending."""
    onset, vowels, coda = SYLLABLES[script]
    n = len(onset) * len(vowels) * len(coda)
    number, said = number + n + 1, []  # bijective numeration; the first n numbers have one syllable
    while number:
        number, at = divmod(number - 1, n)
        a, rest = divmod(at, len(vowels) * len(coda))
        b, c = divmod(rest, len(coda))
        said.append(onset[a] + vowels[b] + coda[c])
    return "".join(reversed(said)) + ending


def _name(key: bytes, role: str, small: str) -> str:
    """One part of a name, in small letters."""
    script = script_of(small)
    pooled = _POOLED.get((script, role), {})
    if small in pooled:
        return folded(POOLS[script][role][permute(key, len(pooled), f"{script}|{role}", pooled[small])])
    plain, more = LETTERS[script]
    simple = all(c in plain for c in small)
    letters = plain if simple else plain + more
    x = 0
    for c in small:
        x = x * len(letters) + letters.index(c)
    size = len(letters)
    tweak = f"{script}|{role}|{len(small)}|{simple}"
    x = permute(key, size ** len(small), tweak, x) + sum(size**i for i in range(1, len(small)))
    form = _inflection(small) if role == "family" else None
    return _spelled(script, 2 * x + (not simple), ENDINGS[script][form or role])


def _like(old: str, new: str) -> str:
    return new.upper() if len(old) > 1 and old.isupper() else new[:1].upper() + new[1:] if old[:1].isupper() else new


def _person(key: bytes, role: str, text: str) -> str:
    out = []
    for i, part in enumerate(_parts(text)):
        if i % 2 or not part:
            out.append(part)
            continue
        small = folded(part)
        feminine = role == "family" and _inflection(small) == "family-f"
        new = _name(key, role, small[:-1] if feminine else small)
        out.append(_like(part, new + "а" if feminine else new))
    return "".join(out)


@lru_cache(1 << 13)
def surrogate(key: bytes, kind: str, text: str) -> str:
    """The replacement of an entity; kind is one of email, secret, ip, account, phone, id, iban, f, m, n (given
    name of a woman, of a man, of either), family."""
    if kind in ROLES:
        return _person(key, kind, text)
    if kind == "email":
        name, _, domain = text.partition("@")
        inner, dot, top = domain.rpartition(".")
        return _cased(f"{name}@{inner}", reshape(key, kind, folded(f"{name}@{inner}"))) + dot + top
    if kind == "secret":
        for alphabet in _HEX:
            if set(text) <= set(alphabet):
                return reshape(key, kind, text, {c: (alphabet, i) for i, c in enumerate(alphabet)})
        return reshape(key, kind, text)
    if kind == "ip":
        x = 0
        for part in text.split("."):
            x = x << 8 | int(part)
        x = permute(key, 1 << 32, kind, x)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    one = canonical(kind, text)
    if kind == "iban":
        return _respelled(text, _iban(key, one), lambda c: c != " ")
    if kind == "account":
        return _respelled(text, _account(key, one), str.isdigit)
    head = country_code(one) if kind == "phone" else ""
    fresh = head + reshape(key, f"{kind}{head}|{len(one)}", one[len(head) :])
    return _respelled(text, fresh.lstrip("+"), str.isdigit)


def labelled(key: bytes, kind: str, text: str) -> str:
    """What stands for an entity that no version of the key frees of a collision: its kind and a keyed hash."""
    return f"[{kind} {hmac.digest(key, f'{kind}|{canonical(kind, text)}'.encode(), 'sha256').hex()[:24]}]"
