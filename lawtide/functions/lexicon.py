"""Stem lexicons: which paragraphs are worth scoring, and which topics they touch."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawtide.functions.text import WORD_CHAR, literal_map

# Stems per topic of the HR scope. A stem matches at a word start
# and takes any ending.
HR_TOPICS = {
    "1. Munkaviszony, Munka törvénykönyve (Mt.)": """
        munka
        munkaviszony
        munkaszerződés
        munkáltató
        munkavállaló
        munkavégzés
        munkaviszony
        munkabér
        próbaidő
        felmond
        alkalmazott
        alkalmaz
        foglalkoztat
        foglalkoztató
        jogviszony
    """,
    "2. Bér, SZJA, szocho": """
        bér
        személyi jövedelemadó
        szja
        szocho
        szociális hozzájárulási adó
        minimálbér
        garantált bérminimum
        bérminimum
        bérköltség
        bérszámfejtés
        béren kívüli juttatás
        bérjövedelem
    """,
    "3. Béren kívüli juttatások, cafeteria": """
        cafeteria
        szép-kártya
        szépkártya
        széchenyi pihenő
        rekreációs keret
        iskolakezdési támogatás
        erzsébet
        önkéntes (pénztár|nyugdíjpénztár)
        lakáscélú támogatás
    """,
    "4. Munkaidő, pihenőidő": """
        munkaidő
        munkaidőkeret
        túlóra
        túlmunka
        pihenőidő
        pihenőnap
        munkaszüneti nap
        távmunka
        home office
        home-office
        készenlét
        éjszakai munka
        vasárnapi pótlék
        munkabeosztás
    """,
    "5. Szabadság, pótszabadság, szülői szabadság": """
        szabadság
        pótszabadság
        apaszabadság
        szülői szabadság
        szülési szabadság
        gyermekápolási
        betegszabadság
    """,
    "6. Munkavédelem, foglalkozás-egészségügy": """
        munkavédel
        munkabaleset
        foglalkozás-egészségügy
        foglalkozásegészségügy
        védőeszköz
        kockázatértékelés
        munkavédelmi (képviselő|szabály)
    """,
    "7. Társadalombiztosítás, nyugdíj, egészségbiztosítás": """
        társadalombiztosítás
        tb-járulék
        nyugdíjbiztosítás
        egészségbiztosítás
        nyugdíj
        táppénz
        csecsemőgondozási díj
        gyermekgondozási díj
        gyed
        csed
        tb járulék
    """,
    "8. Foglalkoztatási jogviszonyok (atipikus foglalkoztatás)": """
        megbízás
        megbízási jogviszony
        alkalmi munka
        egyszerűsített foglalkoztatás
        diákmunka
        diák-szövetkezet
        önkéntes (munka|szerződés)
        4 napos munkahét
        négy napos munkahét
    """,
    "9. Foglalkoztatás-támogatás, képzés, GINOP+": """
        álláskeresési járadék
        álláskeresési segély
        képzési támogatás
        ginop
        munkaadói járulékkedvezmény
        munkahelyvédelmi akcióterv
        rehabilitációs hatóság
        első munkahely garancia
    """,
    "10. Külföldi munkavállalók, harmadik országbeliek": """
        munkavállalási engedély
        munkavállalási jogosultság
        blue card
        szezonális munkavállal
        kirendelés
        külföldi munkavállaló
        harmadik országbeli
        tartózkodási engedély
    """,
    "11. Egyenlő bánásmód, esélyegyenlőség": """
        esélyegyenlőség
        egyenlő bánásmód
        diszkrimináció
        akadálymentesítés
        fogyatékossággal élő
        fogyatékos munkavállaló
        védett tulajdonság
    """,
    "12. Rehabilitációs hozzájárulás, megváltozott munkaképességűek": """
        rehabilitációs hozzájárulás
        megváltozott munkaképesség
        megváltozott munkaképességű
        akkreditált foglalkoztató
    """,
    "13. Munkaügyi hatóság, munkaügyi adatkezelés, GDPR munkaügyi": """
        munkaügyi (hatóság|ellenőrzés|felügyelőség)
        gdpr
        adatkezelés
        adatvédelmi
        visszaélés-bejelentés
        belső visszaélés-bejelentési rendszer
        whistleblowing
    """,
    "14. Szakszervezet, üzemi tanács, kollektív szerződés": """
        üzemi tanács
        szakszervezet
        kollektív szerződés
        érdekegyeztetés
        sztrájk
        üzemi megbízott
    """,
}
# Stems that count as a hit but name no topic.
HR_GENERIC = """
    munkajog
    munkajogi
    hr
    humánerőforrás
"""

# A lexicon is configuration; a table larger than this is a mistake.
MAX_LEXICON_ROWS = 20_000


def stems_of(block: str) -> tuple[str, ...]:
    return tuple(line.strip() for line in block.strip().splitlines() if line.strip())


@dataclass(frozen=True)
class Scope:
    """One named lexicon with its relevance threshold."""

    name: str
    topics: Mapping[str, tuple[str, ...]]
    generic: tuple[str, ...] = ()
    threshold: float = 0.50
    all_stems: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        stems = [s for group in self.topics.values() for s in group] + list(self.generic)
        object.__setattr__(self, "all_stems", tuple(dict.fromkeys(stems)))


HR_SCOPE = Scope("hr", {t: stems_of(b) for t, b in HR_TOPICS.items()}, stems_of(HR_GENERIC))


def word_start(alternatives: str) -> str:
    return rf"(?<![{WORD_CHAR}])(?:{alternatives})"


def plain_stems(stem: str) -> list[str] | None:
    """A stem written out without its alternations; None if it has other pattern syntax."""
    if set(stem) & set("\\[]{}^$.?*+"):
        return None
    if "(" not in stem and ")" not in stem:
        return [s for s in stem.split("|") if s]
    group = re.search(r"\(([^()]*)\)", stem)
    if group is None:
        return None
    written: list[str] = []
    for choice in group.group(1).split("|"):
        rest = plain_stems(stem[:group.start()] + choice + stem[group.end():])
        if rest is None:
            return None
        written.extend(rest)
    return written


def all_plain(stems: Iterable[str]) -> list[str] | None:
    lists = [plain_stems(s) for s in stems]
    return None if None in lists else list(dict.fromkeys(s for group in lists for s in group))


def shared_prefixes(stems: Iterable[str], longest: bool) -> str:
    """One pattern for many stems, common beginnings written once.

    `longest` matches the longest stem at a place; else the shortest, which is
    enough for a yes/no answer and leaves out every stem that starts with another.
    """
    tree: dict = {}
    for stem in stems:
        node = tree
        for char in stem:
            node = node.setdefault(char, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ends = "" in node
        if ends and not longest:
            return ""
        branches = [re.escape(c) + pattern(n) for c, n in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
        return f"(?:{body})?" if ends else body

    return pattern(tree)


def topic_pattern(stems: Iterable[str]) -> str:
    """Any of the stems, as they are written, at a word start."""
    return word_start("|".join(dict.fromkeys(stems)))


def hit_pattern(stems: Iterable[str]) -> str:
    """Same answer as `topic_pattern`, with less to try per word."""
    plain = all_plain(stems)
    return topic_pattern(stems) if plain is None else word_start(shared_prefixes(plain, longest=False))


def searched_text(text: Column, context: Column | None = None) -> Column:
    """What the lexicon looks at: paragraph, line break, context; lower case."""
    extra = F.lit("") if context is None else F.coalesce(context, F.lit(""))
    return F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), extra))


def keyword_hit(searched: Column, scope: Scope = HR_SCOPE) -> Column:
    return searched.rlike(hit_pattern(scope.all_stems))


def found_stems(searched: Column, scopes: Sequence[Scope]) -> Column | None:
    """The longest stem at every word start, each once, for all scopes in one pass.

    The stem is captured in a look-ahead, so a stem inside a longer phrase is found
    too. None when a scope has stems with pattern syntax.
    """
    plain = all_plain(s for scope in scopes for s in scope.all_stems)
    if plain is None:
        return None
    pattern = rf"(?<![{WORD_CHAR}])(?=({shared_prefixes(plain, longest=True)}))"
    return F.array_distinct(F.regexp_extract_all(searched, F.lit(pattern), F.lit(1)))


def stem_topics(scope: Scope, stems: Iterable[str]) -> dict[str, list[str]]:
    """Topics a found stem stands for: its own and those of every stem it starts with.

    Found stems that belong to other scopes only are absent.
    """
    owners: dict[str, set[str]] = {}
    for topic, group in [*scope.topics.items(), (None, scope.generic)]:
        for stem in all_plain(group) or []:
            owners.setdefault(stem, set()).update([topic] if topic else [])
    table = {}
    for stem in stems:
        under = [owners[stem[:n]] for n in range(1, len(stem) + 1) if stem[:n] in owners]
        if under:
            table[stem] = sorted(set().union(*under))
    return table


def tags_of(found: Column, scope: Scope, scopes: Sequence[Scope]) -> Column:
    """Sorted topics of one scope from found stems; NULL when the scope is not hit."""
    plain = all_plain(s for each in scopes for s in each.all_stems) or []
    table = literal_map(stem_topics(scope, plain))
    groups = F.filter(F.transform(found, lambda s: F.try_element_at(table, s)), lambda g: g.isNotNull())
    return F.when(F.size(groups) > 0, F.array_sort(F.array_distinct(F.flatten(groups))))


def tags_by_pattern(searched: Column, scope: Scope) -> Column:
    """`tags_of` for stems with pattern syntax: one search per topic."""
    found = [
        F.when(searched.rlike(topic_pattern(stems)), F.lit(topic))
        for topic, stems in sorted(scope.topics.items())
    ]
    tags = F.filter(F.array(*found), lambda t: t.isNotNull()) if found else F.array().cast("array<string>")
    return F.when(keyword_hit(searched, scope), tags)


def scopes_from_table(lexicon: DataFrame, thresholds: Mapping[str, float] | None = None) -> list[Scope]:
    """Scopes of a lexicon table (scope, topic, pattern); a NULL topic holds generic stems."""
    rows = lexicon.select("scope", "topic", "pattern").limit(MAX_LEXICON_ROWS + 1).collect()
    if len(rows) > MAX_LEXICON_ROWS:
        raise ValueError(f"lexicon table has more than {MAX_LEXICON_ROWS} rows")
    topics: dict[str, dict[str, tuple[str, ...]]] = {}
    generic: dict[str, tuple[str, ...]] = {}
    for row in sorted(rows, key=lambda r: (r.scope, r.topic or "", r.pattern)):
        topics.setdefault(row.scope, {})
        if row.topic is None:
            generic[row.scope] = generic.get(row.scope, ()) + (row.pattern,)
        else:
            topics[row.scope][row.topic] = topics[row.scope].get(row.topic, ()) + (row.pattern,)
    limits = thresholds or {}
    return [
        Scope(name, groups, generic.get(name, ()), limits.get(name, 0.50))
        for name, groups in topics.items()
    ]
