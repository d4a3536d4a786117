"""Whose paper it is: the buyer's VAT number from a text, by a client's profile."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that head the buyer's and the receiver's block, and how many characters of it count.
BILL_TO = ["BILL TO", "BILLED TO", "INVOICE TO", "SOLD TO", "ACHETEUR", "CLIENT"]
SHIP_TO = ["SHIP TO", "DESTINATAIRE", "IMPORTATEUR", "CONSIGNEE", "ULTIMATE CONSIGNEE"]
WINDOW = 900


@dataclass(frozen=True)
class Profile:
    """A client's entities: (VAT, SIREN) pairs, upper-case names and addresses with the VAT each stands for, and words that mark its invoices; orders count.

    scope holds the six-digit heads of its tariff codes (empty: all), known_ids numbers that are none, prefixes what no code begins with.
    """

    entities: list[tuple[str, str]]
    names: list[tuple[str, str]] = field(default_factory=list)
    addresses: list[tuple[str, str]] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    scope: list[str] = field(default_factory=list)
    known_ids: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)

    @property
    def vats(self) -> list[str]:
        return [v for v, _ in self.entities]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def context(text: Column, labels: list[str]) -> Column:
    """What follows the first place of each label, label included, joined by line ends."""
    up = F.upper(text)
    return F.concat_ws("\n", *(F.when(up.contains(x), F.substring(text, F.instr(up, x), F.lit(WINDOW))) for x in labels))


def _none() -> Column:
    return F.lit(None).cast("string")


def siren_evidence(text: Column, p: Profile) -> Column:
    """The VAT of the one entity whose SIREN stands in the text's digits; null if none or several do."""
    d = _digits(text)
    hits = F.array_distinct(F.array_compact(F.array(*(F.when(d.contains(s), v) for v, s in p.entities if s), _none())))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def identity_vat(text: Column, p: Profile) -> Column:
    """One of the client's VATs: by a sole SIREN, a name, an address, then any SIREN or VAT digits."""
    up, d = F.upper(text), _digits(text)
    aliases = [F.when(up.contains(m), v) for m, v in [*p.names, *p.addresses]]
    tail = [F.when((F.lit(bool(s)) & d.contains(s)) | d.contains("".join(c for c in v if c.isdigit())), v) for v, s in p.entities]
    return F.coalesce(siren_evidence(text, p), *aliases, *tail, _none())


def buyer_vat(text: Column, read: Column, p: Profile) -> Column:
    """A struct (vat, source) from a text and the VAT read so far (null if none). In turn: the client's identity in the buyer's
    block, the receiver's or the whole text, unless the VAT read is the client's; the VAT read; the last French VAT number; eleven
    spaced digits after FR; noisy digits that begin with a VAT of the client."""
    current = F.nullif(F.upper(read), F.lit(""))
    ours = F.coalesce(current.isin(p.vats), F.lit(False))
    identity = F.coalesce(identity_vat(context(text, BILL_TO), p), identity_vat(context(text, SHIP_TO), p), identity_vat(text, p))
    plain = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(FR\d{11})\b"), F.lit(1)), F.lit(-1))
    spaced = F.nullif(_digits(F.regexp_extract(text, r"(?i)\bFR\s*((?:[0-9]\s*){11})\b", 1)), F.lit(""))
    noisy = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bFR\s*([0-9][0-9\s]{9,16})\b"), F.lit(1)), lambda v: F.concat(F.lit("FR"), _digits(v)))
    known = F.transform(noisy, lambda v: F.coalesce(*(F.when(v.startswith(x), x) for x in p.vats), _none()))
    steps = [("identity", F.when(~ours, identity)), ("read", current), ("text", plain), ("spaced", F.concat(F.lit("FR"), spaced)), ("noisy", F.get(F.array_compact(known), F.lit(0)))]
    return F.coalesce(*(F.when(v.isNotNull(), F.struct(v.alias("vat"), F.lit(s).alias("source"))) for s, v in steps))
