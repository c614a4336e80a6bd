"""Template residue, filler, error pages and script notices, by a linear classifier on hashed n-grams.

Weak labels come from the response status and from phrases: a sentence with an unfilled placeholder or
filler words is template residue, one with an error phrase is error wording, as is a sentence under a
failed status beside little but such wording; sentences of pages fetched well and without such wording
are content.  Two regularised logistic regressions, one per class, on hashed words, word pairs, letter
n-grams of odd tokens, sentence length, share of different words and heading, that of error wording also
on words of the page's title and the recorded failure reason, learn from a bounded sample and judge every sentence of every record.

The classifier decides, and the only check after it is that words strung together over and over are junk
and no residue: a record is residue if one of its sentences is template residue, or if
error wording makes up most of what the page says, navigation apart.  What is quoted, stands in fenced
code or between back-ticks is shown, not left over, and is not judged.  Null, empty and blank texts are
none.  ``held_out_report`` measures a fit that never saw some hosts and some wordings on just those.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions.urls import host_of
from webstrata.llm.language import COMMON, FILLER
from webstrata.llm.lookalike import HOMOGLYPHS, INVISIBLE
from webstrata.llm.sampling import bounded_sample

SAMPLE_RECORDS = 4000
SAMPLE_SENTENCES = 40_000
BITS = 17
PENALTY, ROUNDS, RATE = 1e-5, 100, 0.5
THRESHOLD, ERROR_THRESHOLD = 0.55, 0.3  # of template residue; of error wording, which has to fill a page as well
HELD_OUT = 5
CLASSES = ("template", "error", "content")
KEPT = 150_000

# Forms of unfilled placeholders.
PLACEHOLDERS = [
    r"\{\{[^{}\n]{0,60}\}\}", r"[$#]\{[^{}\n]{1,60}\}", r"<%[=-]?\s[^%\n]{1,80}%>", r"\{%[^%\n]{1,80}%\}", r"\[\[\s?[\w.]+\s?\]\]", r"%%\w+%%", r"@@\w+@@",
    r"\*\|[\w:]+\|\*", r"<<\s?\w+\s?>>", r"(?<!\w)__[A-Za-z]+_[A-Z]+__(?!\w)", r"\[(?:INSERT|YOUR|ADD|ENTER)\b[^\]\n]{0,40}\]", r"(?<![\w$#{%])\{[a-z][a-z_.]{1,30}\}(?!\})",
    r"(?<![\w$#{%])\{\d\}", r"\b(?:TODO|FIXME|TBD):\s", r"(?<![\w.'\"])undefined(?![\w.'\"])", r"(?<![\w.])NaN(?![\w.])", r"\bnull null\b", r"\[object Object\]", r"\[object \w+\]",
    r"(?i)\byour (?:\w+ ){1,2}goes here\b", r"(?i)\bescribe aquí tu\b", r"(?i)\b(?:escreva|digite|insira|coloque) aqui (?:[oa] )?(?:seu|sua)\b", r"(?i)\b(?:votre|saisissez|écrivez) (?:\w+ ){0,2}ici\b",
    r"(?i)\bhier (?:steht|kommt|folgt) (?:ihre?|deine?) \w+", r"(?i)\b(?:scrivi|inserisci) qui (?:il|la|i|le) tu\w+\b", r"(?i)здесь (?:будет|должен быть) ваш\w* \w+", r"(?i)\bsample text\b", r"(?i)\bplaceholder text\b",
]
# Phrases of error pages, access checks and script notices.
PHRASES = [
    r"not found\b", r"no longer (?:exists?|available|online)", r"nothing (?:lives )?here", r"may have been (?:removed|deleted|moved)", r"access denied", r"forbidden", r"something went wrong", r"unexpected error",
    r"internal (?:server |fault|error)", r"could not complete (?:the|your) request", r"service unavailable", r"out of service", r"down for maintenance", r"too many requests", r"not a robot", r"looks automated", r"solve the puzzle",
    r"connect timeout", r"upstream", r"^traceback\b", r"fatal error", r"uncaught exception", r"^incident [0-9a-f]{6,}$", r"^request id\b", r"^err_\w+", r"^http \d{3}$", r"^error \d{3}\b", r"^\d{3} - ", r"turn on javascript", r"javascript is (?:off|switched off|disabled|required)",
    r"script(?:s|ing)?\b.{0,30}\b(?:blocked|disabled|required|off)\b", r"allow scripts", r"needs scripts", r"unsupported browser", r"^loading\.\.\.$", r"^one moment", r"^just a moment",
    r"no encontr\w+ la página", r"página no encontrada", r"acceso denegado", r"algo ha fallado", r"error inesperado", r"servicio no disponible", r"en mantenimiento", r"ya no (?:está|existe)", r"navegador no (?:es un robot|compatible)", r"parece automático", r"activa los scripts", r"permite los scripts", r"necesita javascript",
    r"fue retirado o ha caducado", r"no pudo completar", r"fallo interno", r"los scripts están bloqueados", r"página não encontrada", r"foi removido ou expirou", r"não conseguiu atender", r"falha interna", r"scripts estão bloqueados", r"navegador sem suporte", r"só funciona com javascript", r"acesso negado", r"algo deu errado", r"erro inesperado", r"serviço indisponível", r"em manutenção", r"não existe", r"conteúdo indisponível", r"não é um robô", r"libere os scripts", r"ative o javascript", r"saiu do ar",
    r"page introuvable", r"retirée? ou a expiré", r"n'a pas pu traiter", r"panne interne", r"scripts sont bloqués", r"non pris en charge", r"n'est plus en ligne", r"trop de requêtes", r"activer javascript", r"accès refusé", r"erreur inattendue", r"service indisponible", r"en maintenance", r"n'existe plus", r"pas un robot", r"semble automatique", r"autorisez les scripts", r"activez javascript", r"il n'y a rien ici",
    r"seite nicht gefunden", r"entfernt oder ist abgelaufen", r"konnte die anfrage nicht", r"interne störung", r"nicht mehr da\b", r"inhalt nicht verfügbar", r"browser wird nicht", r"zu viele anfragen", r"zugriff verweigert", r"unerwarteter fehler", r"dienst nicht erreichbar", r"gibt es nicht mehr", r"kein roboter", r"wirkt automatisch", r"skripte (?:sind aus|erlauben)", r"schalten sie javascript", r"etwas ist schiefgelaufen",
    r"pagina non trovata", r"rimosso o è scaduto", r"non ha completato la richiesta", r"guasto interno", r"script sono bloccati", r"browser non supportato", r"troppe richieste", r"accesso negato", r"errore imprevisto", r"servizio non disponibile", r"in manutenzione", r"non esiste più", r"non sia un robot", r"sembra automatico", r"consenti gli script", r"attiva javascript", r"non è più in linea", r"contenuto non disponibile",
    r"страница не найдена", r"удалено или устарело", r"не смог выполнить запрос", r"больше нет на сайте", r"браузер не подходит", r"разрешите скрипты", r"слишком много запросов", r"доступ запрещ[её]н", r"неожиданная ошибка", r"сервис недоступен", r"технические работы", r"не существует", r"не робот", r"похож на автоматический", r"скрипты (?:отключены|запрещены)", r"включите javascript", r"материал недоступен", r"здесь ничего нет", r"внутренний сбой",
]
_PLACEHOLDER = re.compile("|".join(f"(?:{p})" if "(?i)" not in p else f"(?i:{p.replace('(?i)', '')})" for p in PLACEHOLDERS))
_PHRASE = re.compile("|".join(PHRASES))  # of lower-case text
_FILLER = set(COMMON[FILLER].split()) - {"in", "est", "id", "do", "ex", "ad", "et", "non", "sed", "ut", "sunt", "qui", "ea", "eu"}
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_SHOWN = re.compile(r"`[^`\n]+`|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»|‘[^’\n]{3,}’")
_HEADING = re.compile(r"^\s*#{1,6}\s+")
_ITEM = re.compile(r"^\s*(?:[*+•|-]|\d{1,3}[.)])\s|.*[;\t].*[;\t]|.*\S {2,}\S|[^.!?]{1,60}$")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[^\Wa-zа-я]|[\[{<$#%@*_])")
_JOINT = re.compile(r"\s[|·•›»/]\s|\s[|·•›»]|\)\s+\[")
_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)")
_END = re.compile(r"[.!?…][\"'”»)*_]*$")
_DIGITS = re.compile(r"\d+")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b")
_ODD = re.compile(r"[^\w\s.,;:!?'’\"()–—-]|_")
_RUN = re.compile(r"[^\W\d_]+")
_SUSPECT = re.compile(r"[{}\[\]<>$%@#*|_]|\b(?:undefined|NaN|null|TODO|TBD|FIXME)\b")
_FOLD = str.maketrans({c: latin for latin, others in (x.split(":") for x in HOMOGLYPHS.split()) for c in others})
_DROP = dict.fromkeys(map(ord, INVISIBLE))
_MIXED = re.compile(r"[^\W\d_]*(?:[A-Za-z][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-z])[^\W\d_]*")


def clean(text: str) -> str:
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text.translate(_DROP))
    return _MIXED.sub(lambda m: m.group(0).translate(_FOLD), text)


def sentences(text: str) -> Iterator[tuple[str, bool]]:
    """(sentence, whether it is a heading) of what the text itself says; tokens that may be left over
    from code or a template are given with their neighbours as well."""
    fenced = False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and line and not line.isspace():
            line = clean(line)
            if "`" in line or "“" in line or "«" in line or "„" in line or "‘" in line:
                line = _SHOWN.sub(" ", line)
            heading = bool(_HEADING.match(line))
            line = _HEADING.sub("", line).strip() if heading else line.strip()
            if len(line) < 120:
                parts = [line] if line else []
            else:
                parts = [x for part in _SENTENCE.split(line) if (x := part.strip())]
            for part in parts:
                yield part, heading
                if len(part) > 40 and _SUSPECT.search(part):
                    tokens = part.split()
                    begin = end = -9
                    for i, token in enumerate(tokens):
                        if _SUSPECT.search(token):
                            if i - end > 3:
                                if end >= 0:
                                    yield " ".join(tokens[max(0, begin - 1) : end + 2]), False
                                begin = i
                            end = i
                    if end >= 0:
                        yield " ".join(tokens[max(0, begin - 1) : end + 2]), False


def is_filler(sentence: str) -> bool:
    words = [w.strip(".,;:!?").lower() for w in sentence.split()]
    return len(words) >= 3 and sum(w in _FILLER for w in words) >= 0.5 * len(words)


def is_strung(sentence: str) -> bool:
    """Whether a sentence strings few words together in ever other order, which is junk and no residue; a
    phrase that is repeated is not."""
    words = sentence.split()
    few = len(set(words))
    return len(words) >= 8 and 2 * few <= len(words) and 2 * len(set(zip(words, words[1:]))) > 3 * few


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) & ((1 << BITS) - 1)


class Features:
    """Hashed features of sentences; those of a token and of a pair are worked out once."""

    def __init__(self) -> None:
        self.tokens: dict[str, tuple[list[int], str]] = {}
        self.pairs: dict[str, int] = {}
        self.ends = {(n, h, u): [_hash(f"n{n}"), _hash(f"h{h}"), _hash(f"u{u}")] for n in range(13) for h in (False, True) for u in range(6)}

    def token(self, raw: str) -> tuple[list[int], str]:
        low = _DIGITS.sub("0", _HEX.sub("00000000", raw.lower()))
        word = low.strip(".,;:!?\"'()")
        out = [_hash(word)]
        if len(word) > 5:
            out.append(_hash(f"p{word[:5]}"))
        if _ODD.search(low):
            shape = _DIGITS.sub("0", _RUN.sub("a", raw))
            out.append(_hash(f"s{shape}"))
            out.extend(_hash(f"c{shape[i : i + 3]}") for i in range(len(shape) - 2))
        if len(self.tokens) > KEPT:
            self.tokens.clear()
        self.tokens[raw] = (out, word)
        return self.tokens[raw]

    def pair(self, pair: str) -> int:
        if len(self.pairs) > 2 * KEPT:
            self.pairs.clear()
        self.pairs[pair] = found = _hash(pair)
        return found

    def __call__(self, sentence: str, heading: bool) -> list[int]:
        raws = sentence.split()
        out = list(self.ends[min(len(raws), 12), heading, 5 * len(set(raws)) // max(1, len(raws))])
        before = "^"
        tokens, pairs = self.tokens, self.pairs
        for raw in raws:
            ids, word = tokens.get(raw) or self.token(raw)
            out.extend(ids)
            pair = f"{before} {word}"
            found = pairs.get(pair)
            out.append(self.pair(pair) if found is None else found)
            before = word
        out.append(self.pair(f"{before} $"))
        return out


def is_listing(page: str) -> bool:
    """Whether most lines are list items or rows of values."""
    lines = [x for x in page.split("\n") if x.strip()]
    return len(lines) >= 4 and sum(bool(_ITEM.match(x)) for x in lines) >= 0.6 * len(lines)


def is_navigation(sentence: str) -> bool:
    """Whether a line is a row of menu entries or links by its form."""
    return not sentence.startswith("|") and not _END.search(sentence) and (len(_JOINT.findall(sentence)) >= 2 or not _LINK.sub("", sentence).strip(" *-|·•›»"))


def wording_kind(sentence: str, phrase: re.Pattern[str] = _PHRASE) -> str | None:
    """What residue the wording states, for a weak label: template (a placeholder or filler), error, or
    None."""
    if _PLACEHOLDER.search(sentence) or is_filler(sentence):
        return "template"
    return "error" if phrase.search(sentence.lower()) else None


def flagged_share(said: list[tuple[str, bool, str | None]]) -> float:
    """The share of the page's text, headings and navigation apart, whose wording is that of residue."""
    parts = [(len(s), kind) for s, heading, kind in said if not heading and not is_navigation(s)]
    return sum(n for n, kind in parts if kind) / max(1, sum(n for n, _ in parts))


def weak_label(kind: str | None, failed: bool, share: float, said: int, listing: bool) -> str | None:
    """template, error or content; None where neither status nor wording says.  ``kind``: that of the
    sentence's wording, ``share``: of flagged text on the page, ``said``: the page's sentences.  A long
    page is labelled as a short one is, but for a failed page of a few sentences, all of which are error
    wording."""
    if kind == "template":
        return kind
    if listing and not failed:
        return "content"
    if kind == "error" or (failed and (share >= 0.5 or said <= 3)):
        return "error"
    return "content" if share == 0 and not failed else None


def fit(rows: list[tuple[list[int], int]]) -> np.ndarray:
    """Weights, the bias last, of a logistic regression with balanced classes; AdaGrad on all rows."""
    size = (1 << BITS) + 1
    weights = np.zeros(size)
    if not rows or len({y for _, y in rows}) < 2:
        weights[-1] = -5.0
        return weights
    lengths = np.array([len(x) for x, _ in rows])
    columns = np.concatenate([x for x, _ in rows]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    y = np.array([y for _, y in rows], float)
    scale = 1 / np.sqrt(lengths)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    memory = np.full(size, 1e-8)
    for _ in range(ROUNDS):
        z = np.add.reduceat(weights[columns], starts) * scale + weights[-1]
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.bincount(columns, np.repeat(error * scale, lengths), size) + PENALTY * weights
        gradient[-1] = error.sum()
        memory += gradient * gradient
        weights -= RATE * gradient / np.sqrt(memory)
    return weights


def page_features(title: str | None, reason: str | None) -> tuple[int, ...]:
    """Hashed features of a page around its sentences: words of its title, its failure reason."""
    words = {_DIGITS.sub("0", w.strip(".,;:!?\"'()").lower()) for w in clean(title or "").split()}
    return (_hash(f"r:{reason or ''}"), _hash(f"t#{min(len(words), 9)}"), *sorted(_hash(f"t:{w}") for w in words if w))


class Judge:
    """Scores sentences; what a short sentence adds up to is kept, as sites repeat them.  The weights of
    both classes are held as the parts of one complex number, and added in one go."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.around, self.known, self.features = (weights[0] + 1j * weights[1]).tolist(), weights[1], {}, Features()
        self.pages: dict[tuple[str | None, str | None], tuple[float, int]] = {}

    def page(self, title: str | None, reason: str | None) -> tuple[float, int]:
        key = (title, reason)
        if key not in self.pages:
            if len(self.pages) > KEPT:
                self.pages.clear()
            x = page_features(title, reason)
            self.pages[key] = (float(self.around[list(x)].sum()), len(x))
        return self.pages[key]

    def sentence(self, sentence: str, heading: bool, page: tuple[float, int]) -> tuple[float, float]:
        """The chances that a sentence is template residue and error wording."""
        key = (sentence, heading)
        if (found := self.known.get(key)) is None:
            x = self.features(sentence, heading)
            found = (sum(map(self.weights.__getitem__, x)), len(x))
            if len(sentence) < 120:
                if len(self.known) > KEPT:
                    self.known.clear()
                self.known[key] = found
        (z, n), bias = found, self.weights[-1]
        return _chance(z.real / n**0.5 + bias.real), _chance((z.imag + page[0]) / (n + page[1]) ** 0.5 + bias.imag)

    def record(self, text: str | None, title: str | None = None, reason: str | None = None) -> tuple[float, bool]:
        """The highest score of a sentence, and whether the record is residue."""
        if not text or text.isspace():
            return 0.0, False
        page = self.page(title, reason)
        best, template, hit, plain = 0.0, False, 0, 0
        for sentence, heading in sentences(text):
            t, e = self.sentence(sentence, heading, page)
            if t >= THRESHOLD and is_strung(sentence):
                t = 0.0
            best = max(best, t, e)
            template |= t >= THRESHOLD
            if t >= THRESHOLD or e >= ERROR_THRESHOLD:
                hit += len(sentence)
            elif not heading and not is_navigation(sentence):
                plain += len(sentence)
        # error wording alone makes a page of it only where the page, navigation apart, says little else
        return best, template or (hit > 0 and (plain < 160 or hit >= plain))


def _chance(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


Sample = list[tuple[str, str, bool, tuple[str | None, str | None], str]]


def labelled_sentences(fetches: DataFrame, phrase: re.Pattern[str] = _PHRASE, sample_records: int = SAMPLE_RECORDS) -> Sample:
    """(host, sentence, heading, (title, failure reason), weak label) of the labelled sentences of at most
    ``sample_records`` records, chosen by the hash of their id; residue first, else by the sentence's hash."""
    columns = [host_of(F.col("url")).alias("host"), "markdown", "status", "title", "failure_reason"]
    sample = bounded_sample(fetches, "fetch_id", sample_records).select(*columns)
    names = ["host", "sentence", "heading", "title", "failure_reason", "label"]
    types = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, str | None] = {}
        for batch in batches:
            out = []
            for host, text, status, title, reason in zip(*(c.to_pylist() for c in batch.columns)):
                failed = status is not None and (status >= 400 or status == 0)
                said = []
                for sentence, heading in sentences(text):
                    if sentence not in kinds:
                        kinds[sentence] = wording_kind(sentence, phrase)
                    said.append((sentence, heading, kinds[sentence]))
                share, listing = flagged_share(said), is_listing(text)
                for sentence, heading, kind in said:
                    if (label := weak_label(kind, failed, share, len(said), listing)) is not None:
                        out.append((host or "", sentence, heading, title, reason, label))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    # the bounded sample is labelled by all cores, not by the driver
    spread = sample.repartition(max(2, fetches.sparkSession.sparkContext.defaultParallelism))
    found = spread.mapInArrow(run, "host STRING, sentence STRING, heading BOOLEAN, title STRING, failure_reason STRING, label STRING")
    order = [F.col("label") == "content", F.xxhash64("sentence"), F.xxhash64(*names)]
    rows = found.orderBy(*order).limit(3 * SAMPLE_SENTENCES).collect()
    return [(r.host, r.sentence, r.heading, (r.title, r.failure_reason), r.label) for r in rows]


def fit_sentences(sample: Sample, sample_sentences: int = SAMPLE_SENTENCES) -> np.ndarray:
    """Weights of both classes.  A sentence under several labels counts for its most frequent one; at most
    ``sample_sentences`` distinct ones are used."""
    seen: dict[tuple[str, bool], tuple[tuple[str | None, str | None], list[int]]] = {}
    for _, sentence, heading, page, label in sample:
        key = (sentence, heading)
        if key in seen or len(seen) < sample_sentences:
            seen.setdefault(key, (page, [0, 0, 0]))[1][CLASSES.index(label)] += 1
    features = Features()
    rows = [(features(s, h), page_features(*page), max(range(3), key=votes.__getitem__)) for (s, h), (page, votes) in seen.items()]
    # a template's remains stand on pages of any title: what surrounds them says nothing
    return np.array([fit([(x, int(y == 0)) for x, _, y in rows]), fit([([*x, *around], int(y == 1)) for x, around, y in rows])])


def fit_classifier(fetches: DataFrame) -> np.ndarray:
    """Weights fitted to all hosts and wordings of a bounded sample."""
    return fit_sentences(labelled_sentences(fetches))


def held_out_report(fetches: DataFrame) -> dict[str, float]:
    """Precision and recall of a fit that saw neither one host in five nor one error phrase in five: on the
    weak labels of the hosts left out, and on sentences of the phrases left out, whatever their host."""
    kept = re.compile("|".join(p for i, p in enumerate(PHRASES) if i % HELD_OUT))
    out = lambda host: zlib.crc32(host.encode()) % HELD_OUT == 0
    sample = labelled_sentences(fetches)
    unseen = {s for _, s, _, _, label in sample if label == "error" and _PHRASE.search(s.lower()) and not kept.search(s.lower())}
    inside = [x for x in sample if not out(x[0]) and x[1] not in unseen]
    judge = Judge(fit_sentences(inside))

    def flagged(x: tuple) -> bool:
        t, e = judge.sentence(x[1], x[2], judge.page(*x[3]))
        return t >= THRESHOLD or e >= ERROR_THRESHOLD

    hosts = {x[1:3]: x for x in sample if out(x[0]) and x[1] not in unseen}.values()
    got = [(flagged(x), x[4] != "content") for x in hosts]
    hits = sum(p and y for p, y in got)
    words = [flagged(x) for x in {x[1:3]: x for x in sample if x[1] in unseen}.values()]
    return {
        "train_sentences": float(len(inside)),
        "held_out_sentences": float(len(got)),
        "precision": hits / max(1, sum(p for p, _ in got)),
        "recall": hits / max(1, sum(y for _, y in got)),
        "unseen_wording_sentences": float(len(words)),
        "unseen_wording_recall": sum(words) / max(1, len(words)),
    }


def score_residue(fetches: DataFrame) -> DataFrame:
    """(fetch_id, score, residue) of every record."""
    sent = fetches.sparkSession.sparkContext.broadcast(fit_classifier(fetches))  # two rows of 2^BITS + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for batch in batches:
            found = [judge.record(*x) for x in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p for p, _ in found], pa.float64()), pa.array([r for _, r in found], pa.bool_())],
                names=["fetch_id", "score", "residue"],
            )

    return fetches.select(F.col("fetch_id").cast("long"), "markdown", "title", "failure_reason").mapInArrow(run, "fetch_id LONG, score DOUBLE, residue BOOLEAN")


def residue_records(fetches: DataFrame) -> DataFrame:
    """(fetch_id) of records that are residue, redelivered ones once."""
    return score_residue(fetches).where("residue").select("fetch_id").distinct()
