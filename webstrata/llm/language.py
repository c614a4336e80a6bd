"""Languages of documents and of their lines, by hyperdimensional profiles.

Every letter has a random bipolar vector.  Letters of an n-gram, each permuted by its place, are bound
by multiplication; n-grams of a word are bundled by addition, words likewise.  A language's prototype
bundles the words of sample lines recognised by its common words; what all prototypes share is taken
off, and sample lines that are still told wrong are bundled into the right prototype and out of the
wrong one.  A line takes the language whose prototype has the highest cosine with the line's bundle, a record
the language of most of its words in sentences.

Words that belong to no language (filler text) have a prototype of their own and do not count.  Null,
empty and wordless texts have no language and confidence 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.lookalike import HOMOGLYPHS, INVISIBLE
from webstrata.llm.sampling import bounded_sample

DIMENSIONS, GRAM, SEED, WHOLE_WORD = 1024, 3, 7, 5
SAMPLE_RECORDS = 3000
SAMPLE_LINES, ROUNDS, RATE, MARGIN = 8000, 40, 0.3, 0.1
LONG_WORD = 64
SWITCH = 0.3
KEPT_WORDS = 60_000
FILLER = "zz"

# Common words of each language, and of filler text.
COMMON = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too how little good make world still see own work men day get here old between both life being under three never know same last another while us might great go come since against right came take used himself few house use place during high without again home around small however found mrs part school thought went say general once upon war left every don't does got united number hand course water until always away public something fact less put head think set called nearly enough took end why look",
    "pt": "o a de que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja qual será nós tenho lhe deles essas esses pelas este dele tu te vocês vos lhes meus minhas nosso nossa dela delas esta estes estas aquele aquela isto aquilo estou estamos porque ainda cada onde todos tudo sobre antes fazer pode bem dia ano anos tempo vez outra outro embora enquanto",
    "es": "el la de que y a en un ser se no haber por con su para como estar tener le lo todo pero más hacer o poder decir este ir otro ese si me ya ver porque dar cuando él muy sin vez mucho saber qué sobre mi alguno mismo yo también hasta año dos querer entre así primero desde grande eso ni nos llegar pasar tiempo ella sí día uno bien poco deber entonces poner cosa tanto hombre parecer nuestro tan donde ahora parte después vida quedar siempre creer hablar llevar dejar nada cada seguir menos nuevo encontrar los las una del al es son fue era está han hay aunque mientras todavía sus nuestra según durante",
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire me on mon lui nous comme mais pouvoir avec tout aller voir bien où sans tu ou leur homme si deux même mari autre venir moi femme jour prendre trop vie encore rien très aussi la les des une est sont était a été cette ces ses aux leurs peu avant après chez fait être sous toujours donc alors entre depuis jamais ont qu'il c'est d'un d'une n'a l'on parce tandis quand moins mieux notre nos votre",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine ihr ihm doch denn sehr ohne immer weil bereits etwas einige hier jetzt zwischen während seit dieses alle noch ihren ganz",
    "it": "di che è la il un a per in una mi sono ho non ma lo ha le si ti i con cosa se io come da ci no questo qui hai sei del bene tu sì me più al mio perché lei solo te era gli tutto della così mia fare quando ora fatto essere so mai chi o alla tutti molto dei anche detto quello va niente grazie lui voglio abbiamo stato nel suo dove posso oh prima allora siamo poi ne uno un'altra loro delle degli alle agli nella sulla sul dal dalla ancora senza dopo ogni quasi anche mentre durante secondo",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой что весь год от так о для ты же все тот мочь вы человек такой его сказать только или ещё бы себя один как уже до время если сам когда другой вот говорить наш мой знать стать при чтобы дело жизнь кто первый очень два день её новый рука даже во со раз где там под можно ну какой после их работа без самый потом надо хотеть ли слово идти большой должен место иметь ничто было был была были этого того всё нет будет нас вас им них ней него через над хотя потому пока",
    FILLER: "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum nunc massa porta augue viverra suspendisse vestibulum curabitur pellentesque",
}
LANGUAGES = [x for x in COMMON if x != FILLER]
# Names and three-letter codes of the languages.
LABELS = {
    "en": "en eng english inglés inglês anglais englisch inglese английский",
    "pt": "pt por portuguese português portugues portugués portugais portugiesisch portoghese португальский",
    "es": "es spa spanish español espanol castellano espanhol espagnol spanisch spagnolo испанский",
    "fr": "fr fra fre french français francais francés francês französisch francese французский",
    "de": "de deu ger german deutsch alemán alemão allemand tedesco немецкий",
    "it": "it ita italian italiano italien italienisch итальянский",
    "ru": "ru rus russian русский ruso russo russe russisch",
}


def label_language(label: str | None) -> str | None:
    """The language a label names: its two-letter code, another label unchanged, None for no language."""
    if not label or not label.strip():
        return None
    primary = re.split(r"[-_ ]", label.strip().lower())[0]
    for code, names in LABELS.items():
        if primary in names.split():
            return code
    if primary in ("und", "unknown", "xx", "x", "zxx", "mul", "mis", "none", "null", "n/a", "auto"):
        return None
    return primary


class Vectors:
    """Vectors of words, and what they add to the cosine with each prototype."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[str, list[np.ndarray]] = {}

    def letter(self, c: str) -> list[np.ndarray]:
        if c not in self.letters:
            v = (np.random.default_rng([self.seed, ord(c)]).integers(0, 2, self.dimensions) * 2 - 1).astype(np.int16)
            self.letters[c] = [np.roll(v, k) for k in range(GRAM)]
        return self.letters[c]

    def word(self, word: str) -> np.ndarray:
        text = f" {word} "
        if len(word) > LONG_WORD:
            return self.long_word(text)
        total = np.zeros(self.dimensions, np.int16)
        for i in range(len(text) - GRAM + 1):
            gram = self.letter(text[i])[GRAM - 1]
            for k in range(1, GRAM):
                gram = gram * self.letter(text[i + k])[GRAM - 1 - k]
            total += gram
        if len(word) <= WHOLE_WORD:  # short words are n-grams of their own
            gram = self.letter(" ")[0]
            for c in word:
                gram = np.roll(gram, 1) * self.letter(c)[0]
            total += 2 * gram
        return total


    def long_word(self, text: str) -> np.ndarray:
        """The same sum for a run of any length, many n-grams at a time."""
        total = np.zeros(self.dimensions, np.int64)
        for start in range(0, len(text) - GRAM + 1, 2048):
            part = text[start : start + 2048 + GRAM - 1]
            n = len(part) - GRAM + 1
            grams = np.ones((n, self.dimensions), np.int16)
            for k in range(GRAM):
                grams *= np.array([self.letter(c)[GRAM - 1 - k] for c in part[k : k + n]])
            total += grams.sum(axis=0)
        return total


def prototypes(profiles: dict[str, Counter[str]], vectors: Vectors) -> tuple[list[str], np.ndarray]:
    """Unit prototypes of the profiles (word counts), less their mean."""
    names = sorted(profiles)
    rows = []
    for name in names:
        total = np.zeros(vectors.dimensions)
        for word, n in profiles[name].items():
            total += vectors.word(word) * (1 + np.log(n))
        rows.append(total / (np.linalg.norm(total) or 1))
    matrix = np.array(rows)
    matrix -= matrix.mean(axis=0)
    return names, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)


_STRIP = ".,;:!?…\"'“”«»„‘’()[]{}*_>#|–—-¿¡`~"
_FOLD = str.maketrans({c: latin for latin, others in (x.split(":") for x in HOMOGLYPHS.split()) for c in others})
_DROP = dict.fromkeys(map(ord, INVISIBLE))
_LINK = re.compile(r"\[([^\]]*)\]\((?:[^()]|\([^)]*\))*\)")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_NO_SENTENCE = re.compile(r"^\s*(?:#{1,6}\s|[*+•-]\s|\d{1,3}[.)]\s|\|)")
_ENDS = re.compile(r"[.!?…][\"'”»)*_]*(?:\s|$)")
_CYRILLIC = re.compile(r"[а-яё]", re.I)
_GREEK_CYRILLIC = re.compile(r"[Ͱ-ӿ]")
_LATIN = re.compile(r"[a-z]", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def _one_script(m: re.Match[str]) -> str:
    word = m.group(0)
    return word.translate(_FOLD) if _LATIN.search(word) else word


def plain_line(line: str) -> str:
    """A line without links' addresses, invisible characters and letters of a second script in a word."""
    if "](" in line:
        line = _LINK.sub(r"\1", line)
    if not line.isascii():
        line = unicodedata.normalize("NFKC", line.translate(_DROP))
        if _GREEK_CYRILLIC.search(line):
            line = _WORD.sub(_one_script, line)
    return line


def sentence_lines(text: str) -> Iterator[tuple[int, list[str], int]]:
    """(line number, words to judge by, number of words) of the lines made of sentences: no headings,
    list items, rows or code.  Capitalised words, mostly names, are not judged where others remain."""
    fenced = False
    for number, line in enumerate(text.split("\n"), 1):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and line and not _NO_SENTENCE.match(line):
            line = plain_line(line)
            if _ENDS.search(line) and line.count("|") < 2 and "\t" not in line:
                words = [w for x in line.split() if (w := x.strip(_STRIP)) and not w.isdigit()]
                if len(words) >= 3:
                    low = [w for w in words if not w[0].isupper()]
                    yield number, low if len(low) >= 3 else [w.lower() for w in words], len(words)


class _Table(dict):
    """Word to its row of per-prototype sums; missing words are worked out when first asked for."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> int:
        row = self[word] = self.model.add(word)
        return row


class Model:
    """Scores word lists against the prototypes."""

    def __init__(self, names: list[str], matrix: np.ndarray, vectors: Vectors | None = None) -> None:
        self.names, self.matrix, self.vectors = names, matrix.astype(np.float32), vectors or Vectors()
        self.clear()

    def clear(self) -> None:
        self.rows = _Table(self)
        self.sums = np.zeros((1024, len(self.names) + 1), np.float32)

    def add(self, word: str) -> int:
        n = len(self.rows)
        if n >= len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        if any(c.isalpha() for c in word):
            v = self.vectors.word(word).astype(np.float32)
            self.sums[n, :-1] = self.matrix @ v
            self.sums[n, -1] = v @ v
        return n

    def cosines(self, words: list[str]) -> np.ndarray:
        """Cosine of the words' bundle with each prototype; words' vectors count as orthogonal."""
        total = self.sums_of(words)
        return total[:-1] / np.sqrt(max(total[-1], 1.0))

    def sums_of(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        return self.sums[rows].sum(axis=0)

    def best(self, words: list[str]) -> tuple[str, float]:
        """(language, confidence): the margin over the second best, as a share of the best."""
        scores = self.cosines(words)
        order = np.argsort(scores)
        top, second = scores[order[-1]], scores[order[-2]]
        if top <= 0:
            return FILLER, 0.0
        return self.names[order[-1]], float(min(1.0, (top - max(second, 0.0)) / top))


def seed_model() -> Model:
    vectors = Vectors()
    return Model(*prototypes({k: Counter(v.split()) for k, v in COMMON.items()}, vectors), vectors)


def train(texts: list[str], sample_lines: int = SAMPLE_LINES) -> tuple[list[str], np.ndarray]:
    """Prototypes from sample texts.  A line counts for the language whose common words it has most of;
    such lines are bundled.  Then, a few times over, lines told wrong or by less than ``MARGIN`` are added
    to the prototype of their language and taken off the nearest other one; prototypes stay bundles."""
    common = defaultdict(list)
    for lang, words in COMMON.items():
        for w in set(words.split()):
            common[w].append(lang)
    profiles = {lang: Counter({w: 3 for w in words.split()}) for lang, words in COMMON.items()}
    lines: list[tuple[str, list[str]]] = []
    for text in texts:
        for _, words, _ in sentence_lines(text):
            votes = Counter(lang for w in words for lang in common.get(w, ()))
            ranked = votes.most_common(2)
            if ranked and ranked[0][1] >= max(3, 0.2 * len(words)) and (len(ranked) < 2 or ranked[0][1] >= 1.5 * ranked[1][1]):
                profiles[ranked[0][0]].update(w for w in words if w.isalpha())
                if len(lines) < sample_lines:
                    lines.append((ranked[0][0], words))
    vectors = Vectors()
    names, matrix = prototypes(profiles, vectors)
    for lang, words in COMMON.items():  # every language takes part, whatever the sample holds
        listed = words.split()
        lines.extend((lang, listed[i : i + 8]) for i in range(0, len(listed), 8))
    known: dict[str, np.ndarray] = {}
    bundles = np.zeros((len(lines), vectors.dimensions), np.float32)
    for i, (_, words) in enumerate(lines):
        for w in words:
            if w not in known:
                known[w] = vectors.word(w)
            bundles[i] += known[w]
    bundles /= np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
    truth = np.array([names.index(lang) for lang, _ in lines])
    weight = (1 / np.bincount(truth, minlength=len(names)))[truth, None]  # every language counts alike
    matrix, every = matrix.astype(np.float32), np.arange(len(lines))
    for _ in range(ROUNDS):
        scores = bundles @ matrix.T
        own = scores[every, truth]
        scores[every, truth] = -np.inf
        rival = scores.argmax(axis=1)
        unsure = np.flatnonzero(own - scores[every, rival] < MARGIN)
        move = np.zeros_like(matrix)
        np.add.at(move, truth[unsure], weight[unsure] * bundles[unsure])
        np.add.at(move, rival[unsure], -weight[unsure] * bundles[unsure])
        matrix += RATE * move
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    return names, matrix


def read_record(model: Model, text: str | None) -> tuple[str | None, float, int, list[tuple[int, str, float, int]]]:
    """(main language, confidence, words in sentences, [(line, language, confidence, words)]).

    A line whose best language leads the record's main one by less than ``SWITCH`` of its cosine stays
    with the main one: close languages share most n-grams of a short line."""
    scored = []
    per: Counter[str] = Counter()
    if len(model.rows) > KEPT_WORDS:
        model.clear()
    for number, words, n in sentence_lines(text or ""):
        scores = model.cosines(words)
        lang = model.names[int(np.argmax(scores))]
        if scores.max() > 0 and lang != FILLER:
            scored.append((number, scores, n))
            per[lang] += n
    if not per:
        return None, 0.0, 0, []
    main = per.most_common(1)[0][0]
    own, lines = model.names.index(main), []
    for number, scores, n in scored:
        order = np.argsort(scores)
        at = int(order[-1])
        if scores[own] >= (1 - SWITCH) * scores[at]:
            at = own
        rest = max(scores[order[-2]] if at == order[-1] else scores[order[-1]], 0.0)
        lines.append((number, model.names[at], float(np.clip((scores[at] - rest) / scores[at], 0, 1)) if scores[at] > 0 else 0.0, n))
    total = sum(n for *_, n in lines)
    most = sum(n for _, lang, _, n in lines if lang == main)
    sure = sum(c * n for _, lang, c, n in lines if lang == main) / most
    return main, most / total * sure, total, lines


SCHEMA = "fetch_id LONG, line_no LONG, lang STRING, confidence DOUBLE, n_words LONG, label STRING, main_lang STRING, record_words LONG"


def language_segments(fetches: DataFrame, sample_records: int = SAMPLE_RECORDS) -> DataFrame:
    """Line 0 of each record with its language, and each of its sentence lines with its own.

    Prototypes are fitted to ``sample_records`` records chosen by the hash of their id, at most; every
    record is judged.  ``label`` is the language the record's label names, if any."""
    sample = bounded_sample(fetches, "fetch_id", sample_records).select("markdown")
    fitted = fetches.sparkSession.sparkContext.broadcast(train([r.markdown for r in sample.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*fitted.value)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        labels: dict[str | None, str | None] = {}
        for batch in batches:
            rows: list[tuple] = []
            for fetch_id, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                if label not in labels:
                    labels[label] = label_language(label)
                named = labels[label]
                main, sure, total, lines = read_record(model, text)
                rows.append((fetch_id, 0, main, sure, total, named, main, total))
                rows.extend((fetch_id, n, lang, c, k, named, main, total) for n, lang, c, k in lines)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, types)], names=names)

    return fetches.select(F.col("fetch_id").cast("long"), "language", "markdown").mapInArrow(run, SCHEMA)


def label_faults(fetches: DataFrame) -> DataFrame:
    """(fetch_id, line_no, lang): records of 40 words or more whose label names no or another language,
    at line 0, and their lines of 10 words or more in another language than the record's."""
    found = language_segments(fetches)
    wrong = (F.col("line_no") == 0) & (F.col("label").isNull() | (F.col("label") != F.col("lang")))
    other = (F.col("line_no") > 0) & (F.col("n_words") >= 10) & (F.col("lang") != F.col("main_lang"))
    return found.where((F.col("record_words") >= 40) & (wrong | other)).select("fetch_id", "line_no", "lang").distinct()
