"""Signals in titles and descriptions of listings, as column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bare(letter: str) -> str:
    """What a letter is made of, without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))


_LETTERS = [c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000]
_ACCENTED = "".join(c for c in _LETTERS if len(_bare(c)) == 1 and _bare(c) != c)
_PLAIN = "".join(map(_bare, _ACCENTED))
_JOINED = {c: _bare(c) for c in map(chr, (*range(0xFB00, 0xFB07), 0x133))}

# Word lists by tag in their order, and the patterns after them.
CAR_FEATURES = {
    "M-Sport": ("m sport", "m-sport", "msport", "pacchetto m", "pack m", "m pack"),
    "M-Performance": ("m performance", "m-performance", "m perf"),
    "Automatico": ("automatico", "automatica", "cambio automatico", "steptronic", "s tronic", "s-tronic", "dsg", "tiptronic", "auto "),
    "Full-Optional": ("full optional", "full-optional", "fulloptional", "optional full", "accessoriata", "tutti gli optional"),
    "Navigatore": ("navigatore", "navi ", "navigatore satellitare", "gps"),
    "Tetto-Apribile": ("tetto apribile", "tetto panoramico", "tettuccio", "sunroof"),
    "Pelle": ("interni in pelle", "sedili in pelle", "pelle totale", "full pelle"),
    "Xeno-LED": ("xeno", "xenon", "fari led", "full led", "led adattivi"),
    "Cerchi-Lega": ("cerchi in lega", "cerchi lega", "lega da"),
    "Sensori-Parcheggio": ("sensori di parcheggio", "sensori parcheggio", "park assist", "telecamera posteriore", "retrocamera"),
    "Garanzia": ("garanzia", "garantita", "ancora in garanzia"),
    "Tagliandi": ("tagliandi", "tagliandata", "tagliando", "libretto tagliandi"),
    "Neopatentati": ("neopatentati", "neopatentato", "ok neopatentati"),
}
PHONE_FEATURES = {
    "Scatola": ("scatola", "box originale", "confezione originale", "con la sua scatola"),
    "Fattura": ("fattura", "scontrino", "prova d'acquisto", "prova di acquisto"),
    "Garanzia-Apple": ("applecare", "apple care", "garanzia apple", "garanzia residua", "ancora in garanzia apple"),
    "Caricatore": ("caricatore", "caricabatterie", "cavo originale", "alimentatore originale"),
    "Pari-al-Nuovo": ("pari al nuovo", "come nuovo", "come nuova", "perfette condizioni", "condizioni perfette", "mai caduto", "sempre con custodia", "sempre in custodia"),
    "Batteria-Cambiata": ("batteria nuova", "batteria cambiata", "batteria sostituita", "batteria appena sostituita"),
}
CAR_DEFECTS = {
    "frizione": ("frizione", "frizioni"),
    "graffi": ("graffi", "graffio", "graffiata", "graffiato", "rigata", "rigato"),
    "grandine": ("grandine", "grandinata"),
    "da-rivedere": ("da rivedere", "da sistemare", "da vedere", "da tagliandare"),
    "spia-motore": ("spia motore", "spia del motore", "spia accesa", "spie accese", "check engine"),
    "incidentata": ("incidentata", "incidentato", "sinistrata", "sinistrato", "cappottata", "urtata"),
    "fuso": ("fuso", "motore fuso", "testata", "guarnizione testata", "biella"),
}
PHONE_DEFECTS = {
    "schermo-rotto": ("schermo rotto", "display rotto", "vetro rotto", "schermo crepato", "display crepato", "vetro crepato", "vetro incrinato", "schermo incrinato", "crepa sul", "schermo danneggiato", "display danneggiato"),
    "batteria-esausta": ("batteria da cambiare", "batteria da sostituire", "batteria esausta", "batteria degradata", "batteria ko", "batteria scarsa"),
    "icloud-bloccato": ("icloud bloccato", "blocco icloud", "blocco attivazione", "account icloud attivo", "id apple bloccato"),
    "per-ricambi": ("per ricambi", "per pezzi", "pezzi di ricambio", "solo ricambi", "come ricambio"),
    "da-riparare": ("da riparare", "non funzionante", "non si accende"),
    "face-id-rotto": ("face id non funziona", "face id rotto", "face id non funzionante", "faceid non funziona"),
    "back-rotto": ("scocca rotta", "vetro posteriore rotto", "retro rotto", "back rotto"),
}
URGENCY = {
    "trasferimento": ("trasferimento", "mi trasferisco", "causa trasferimento"),
    "realizzo": ("realizzo", "realizzo causa", "svendo", "svendita"),
    "spazio": ("spazio", "far posto", "fare spazio", "non ho piu spazio"),
    "allargamento": ("allargamento", "allargamento famiglia", "famiglia che cresce"),
    "inutilizzo": ("inutilizzo", "non la uso", "poco utilizzata", "causa inutilizzo", "non utilizzata"),
}
COLORS = {
    "Grafite": ("grafite", "graphite"),
    "Titanio Naturale": ("titanio naturale", "natural titanium", "titanio grezzo"),
    "Nero": ("nero siderale", "space black", "titanio nero", "black titanium", "mezzanotte", "midnight", "nero", "black"),
    "Bianco": ("titanio bianco", "white titanium", "galassia", "starlight", "bianco stellare", "bianco", "white"),
    "Argento": ("argento", "silver"),
    "Blu": ("blu pacifico", "pacific blue", "blu sierra", "sierra blue", "titanio blu", "blue titanium", "ultramarine", "oltremare", "azzurro", "blu", "blue"),
    "Verde": ("verde alpino", "alpine green", "verde notte", "midnight green", "verde", "green"),
    "Teal": ("teal", "verde acqua"),
    "Viola": ("deep purple", "viola intenso", "viola", "purple", "lavanda"),
    "Rosso": ("product red", "rosso", "red"),
    "Oro": ("oro", "gold", "dorato"),
    "Rosa": ("rosa", "pink"),
    "Giallo": ("giallo", "yellow"),
}
ACCESSORIES = (
    "cover", "custodia", "vetro temperato", "vetro protettivo", "vetro posteriore", "pellicola", "proteggi schermo", "screen protector", "caricatore", "caricabatterie",
    "cavo lightning", "cavo usb", "cavo dati", "adattatore", "powerbank", "auricolari", "cuffie", "airpods", "supporto auto", "porta cellulare", "flip cover",
    "custodia a libro", "retro cover", "guscio", "borsa porta cellulare",
)
NOT_MARKET = ("incidentata", "fuso", "schermo-rotto", "icloud-bloccato", "per-ricambi", "da-riparare", "batteria-esausta")
STORAGE = r"(?iU)\b(64|128|256|512)\s*(?:gb|giga)\b"
TERABYTE = r"(?iU)\b1\s*(?:tb|tera)\b"
BATTERY_AFTER, BATTERY_BEFORE = r"(?i)(?:batteria|battery)[^%\d]{0,25}?(\d{2,3})\s*%", r"(?iU)(\d{2,3})\s*%[^\w]{0,5}(?:di\s+)?batteria"
KM_AFTER, KM_BEFORE = r"(?i)(?:km[\s.:]*)?(?<![\d.])(\d{1,3}(?:[.\s]\d{3})+|\d{2,7})\s*(?:mila\s*)?k[m ]", r"(?i)km[\s.:]*(?<![\d.])(\d{1,3}(?:[.\s]\d{3})+|\d{2,7})"
YEAR = r"(?U)\b(19[89]\d|20[0-2]\d)\b"
SCAM = r"(?iU)\b(solo\s+spedizion\w+|niente\s+ritiro|no\s+ritiro|no\s+incontr\w+|pagamento\s+anticipat\w+|ricarica\s+postepay|bonifico\s+anticipat\w+|paypal\s+amici|amici\s+e\s+parenti|no\s+res\w+|nessun\s+reso|western\s+union|money\s*gram|solo\s+contrassegn\w+|spedizione\s+prima\s+del\s+pagamento)\b"


def folded(text: Column) -> Column:
    """Lower case, letters and digits without marks, width and joins, white space squeezed; no Python."""
    apart = F.lower(text)
    for joined, letters in _JOINED.items():
        apart = F.replace(apart, F.lit(joined), F.lit(letters))
    plain = F.when(_any(text, (*_JOINED, "Ĳ")), apart).otherwise(F.lower(text))
    return F.regexp_replace(F.translate(F.regexp_replace(plain, r"\p{Mn}+", ""), _ACCENTED, _PLAIN), r"(?U)\s+", " ")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it occurs in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tags(text: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    """Tags of which some word occurs in a folded text, in the order of the lists."""
    return once(text, lambda t: F.array_compact(F.array(*[F.when(_any(t, words), F.lit(tag)) for tag, words in lists.items()])))


def first_tag(text: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    return once(text, lambda t: F.coalesce(*[F.when(_any(t, words), F.lit(tag)) for tag, words in lists.items()]))


def _first_int(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def storage_gb(text: Column) -> Column:
    return F.when(text.rlike(TERABYTE), F.lit(1024)).otherwise(_first_int(text, STORAGE))


def battery_pct(text: Column) -> Column:
    def plausible(value: Column) -> Column:
        return F.when(value.between(50, 100), value)

    return F.coalesce(plausible(_first_int(text, BATTERY_AFTER)), plausible(_first_int(text, BATTERY_BEFORE)))


def kilometres(text: Column) -> Column:
    """The first plausible number after ``km``, else before it; thousands where the text says ``mila``."""
    every = F.concat(F.regexp_extract_all(text, F.lit(KM_BEFORE), F.lit(1)), F.regexp_extract_all(text, F.lit(KM_AFTER), F.lit(1)))
    thousands = F.contains(F.lower(text), F.lit("mila"))
    values = F.transform(every, lambda m: F.regexp_replace(m, r"\D", "").try_cast("bigint"))
    scaled = F.transform(values, lambda v: F.when((v < 1000) & thousands, v * 1000).otherwise(v))
    return F.try_element_at(F.filter(scaled, lambda v: (v > 0) & (v <= 1_000_000)), F.lit(1)).cast("int")


def year(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")))


def sells_accessory(title: Column) -> Column:
    """Whether a title names an accessory with no phone in it, or before the phone."""
    def named(text: Column) -> Column:
        phone, found = F.locate("iphone", text), F.lit(False)
        for word in ACCESSORIES:
            at = F.locate(word, text)
            found = found | ((at > 0) & ((phone == 0) | (at < phone)))
        return found

    return once(folded(F.coalesce(title, F.lit(""))), named)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def holds_all_words(title: Column, query: Column) -> Column:
    return F.size(F.array_except(tokens(query), tokens(title))) == 0


def slug(text: Column) -> Column:
    """Letters and digits joined by hyphens, ``na`` if none."""
    plain = F.btrim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(plain == "", F.lit("na")).otherwise(plain)


def title_of_url(url: Column) -> Column:
    """A title from the last part of a url without its id and ending, words capitalised."""
    last = F.regexp_replace(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]+)/?$", 1), r"(-\d+)?(\.html?)?$", "")
    return F.initcap(F.regexp_replace(last, "-+", " "))


def id_of_url(url: Column) -> Column:
    """The number before an optional ending at the end of a url's path, null if none."""
    found = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(\d+)(?:\.html?)?/?$", 1)
    return F.when(found != "", found)


def json_value(features: Column, uri: str) -> Column:
    """Value, else key, of the first entry of a feature list by uri."""
    entry = F.try_element_at(F.filter(features, lambda f: f["uri"] == uri), F.lit(1))
    first = F.try_element_at(entry["values"], F.lit(1))
    return F.coalesce(first["value"], first["key"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "").try_cast("int")


def whole_price(text: Column) -> Column:
    """Digits before the decimal comma."""
    return F.regexp_replace(F.split_part(text, F.lit(","), F.lit(1)), r"\D", "").try_cast("bigint")


def euros(value: Column) -> Column:
    """Whole euros with points between thousands."""
    return F.concat(F.translate(F.format_number(value, 0), ",", "."), F.lit(" €"))
