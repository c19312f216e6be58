"""License scans: ordered signature rules behind a keyword prefilter.

A rule has a label, a priority, keywords and a regular expression over the
lower-cased text. A rule's expression runs only on texts that hold one of its
keywords, with any white space for a blank. Where detections overlap, one that lies inside another of the same or a
higher priority is suppressed. The four base phrases are rules over the words of
the text; every place where they stand counts, suppressed or not.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taxaspark.llm import text as X

#: Phrases and labels that decide results (fixed values).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Licenses by hand: label, keywords of which a text must hold one, the ways its name is
# written, and its short identifiers in package metadata.
V = r"(?:,?\s*(?:version|v\.?)?\s*%s(?:\.0)?\b)"
NAMES = (
    ("agpl-3.0", ("affero", "agpl"), r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e" + V % "3", r"agpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("agpl-1.0", ("affero", "agpl"), r"affero\s+general\s+public\s+licen[sc]e" + V % "1", r"agpl-?v?1(?:\.0)?(?:-only|-or-later)?"),
    ("lgpl-2.1", ("lesser", "lgpl"), r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e,?\s*(?:version|v\.?)?\s*2\.1\b", r"lgpl-?v?2\.1(?:-only|-or-later|\+)?"),
    ("lgpl-3.0", ("lesser", "lgpl"), r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e" + V % "3", r"lgpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("lgpl-2.0", ("library", "lgpl"), r"(?:gnu\s+)?library\s+general\s+public\s+licen[sc]e(?:" + V % "2" + ")?", r"lgpl-?v?2\.0(?:-only|-or-later|\+)?"),
    ("gpl-3.0", ("general public", "gpl"), r"(?:gnu\s+)?general\s+public\s+licen[sc]e" + V % "3", r"gpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl-2.0", ("general public", "gpl"), r"(?:gnu\s+)?general\s+public\s+licen[sc]e" + V % "2", r"gpl-?v?2(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl-1.0", ("general public", "gpl"), r"(?:gnu\s+)?general\s+public\s+licen[sc]e" + V % "1", r"gpl-?v?1(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gfdl", ("documentation", "gfdl"), r"(?:gnu\s+)?free\s+documentation\s+licen[sc]e(?:,?\s*version\s*1\.[123])?", r"gfdl(?:-?1\.[123])?(?:-only|-or-later)?"),
    ("apache-2.0", ("apache",), r"apache\s+(?:software\s+)?licen[sc]e" + V % "2", r"apache-?2(?:\.0)?|asl-?2(?:\.0)?"),
    ("apache-1.1", ("apache",), r"apache\s+(?:software\s+)?licen[sc]e,?\s*(?:version|v\.?)?\s*1\.1\b", r"apache-?1\.1"),
    ("apache-1.0", ("apache",), r"apache\s+(?:software\s+)?licen[sc]e,?\s*(?:version|v\.?)?\s*1(?:\.0)\b", r"apache-?1\.0"),
    ("mit", ("mit", "expat"), r"(?:the\s+)?(?:mit|expat)(?:\s*/\s*x11)?[\s-]+licen[sc]e", r"mit(?![-\w])|expat"),
    ("mit-0", ("mit",), r"mit\s+no\s+attribution(?:\s+licen[sc]e)?", r"mit-0"),
    ("bsd-2-clause", ("bsd", "freebsd"), r"(?:2|two)[\s-]+clause\s+bsd(?:\s+licen[sc]e)?|simplified\s+bsd\s+licen[sc]e|bsd\s+2[\s-]+clause(?:\s+licen[sc]e)?", r"bsd-2-clause(?:-patent|-views)?"),
    ("bsd-3-clause", ("bsd",), r"(?:3|three)[\s-]+clause\s+bsd(?:\s+licen[sc]e)?|(?:new|modified|revised)\s+bsd\s+licen[sc]e|bsd\s+3[\s-]+clause(?:\s+licen[sc]e)?", r"bsd-3-clause(?:-clear|-attribution)?"),
    ("bsd-4-clause", ("bsd",), r"(?:4|four)[\s-]+clause\s+bsd(?:\s+licen[sc]e)?|(?:original|old)\s+bsd\s+licen[sc]e", r"bsd-4-clause(?:-uc)?"),
    ("0bsd", ("bsd",), r"(?:0|zero)[\s-]+clause\s+bsd(?:\s+licen[sc]e)?|bsd\s+zero[\s-]+clause(?:\s+licen[sc]e)?", r"0bsd"),
    ("mpl-2.0", ("mozilla", "mpl"), r"mozilla\s+public\s+licen[sc]e" + V % "2", r"mpl-?2(?:\.0)?"),
    ("mpl-1.1", ("mozilla", "mpl"), r"mozilla\s+public\s+licen[sc]e,?\s*(?:version|v\.?)?\s*1\.1\b", r"mpl-?1\.1"),
    ("epl-2.0", ("eclipse", "epl"), r"eclipse\s+public\s+licen[sc]e(?:\s*-)?" + V % "2", r"epl-?2(?:\.0)?"),
    ("epl-1.0", ("eclipse", "epl"), r"eclipse\s+public\s+licen[sc]e(?:\s*-)?" + V % "1", r"epl-?1(?:\.0)?"),
    ("cddl-1.0", ("cddl", "common development"), r"common\s+development\s+and\s+distribution\s+licen[sc]e(?:" + V % "1" + ")?", r"cddl(?:-?1\.[01])?"),
    ("cpl-1.0", ("common public",), r"common\s+public\s+licen[sc]e(?:" + V % "1" + ")?", r"cpl-?1(?:\.0)?"),
    ("isc", ("isc",), r"\bisc\s+licen[sc]e", r"isc"),
    ("zlib", ("zlib",), r"zlib(?:\s*/\s*libpng)?\s+licen[sc]e", r"zlib(?:-acknowledgement)?"),
    ("bsl-1.0", ("boost",), r"boost\s+software\s+licen[sc]e(?:\s*-)?(?:" + V % "1" + ")?", r"bsl-?1(?:\.0)?"),
    ("busl-1.1", ("business source",), r"business\s+source\s+licen[sc]e(?:,?\s*(?:version|v\.?)?\s*1\.1)?", r"busl-?1\.1"),
    ("artistic-2.0", ("artistic",), r"artistic\s+licen[sc]e" + V % "2", r"artistic-?2(?:\.0)?"),
    ("artistic-1.0", ("artistic",), r"artistic\s+licen[sc]e(?:" + V % "1" + ")?", r"artistic-?1(?:\.0)?(?:-perl|-cl8)?"),
    ("unlicense", ("unlicense",), r"\bthe\s+unlicense\b", r"unlicense"),
    ("wtfpl", ("wtfpl", "what the"), r"do\s+what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+licen[sc]e", r"wtfpl"),
    ("cc0-1.0", ("cc0", "creative commons"), r"creative\s+commons\s+(?:zero|cc0)(?:\s+(?:licen[sc]e|public\s+domain\s+dedication))?|cc0\s+(?:licen[sc]e|1\.0)", r"cc0(?:-1\.0)?"),
    ("cc-by-4.0", ("creative commons", "cc"), r"creative\s+commons\s+attribution\s+4\.0(?:\s+international)?|cc[\s-]by\s+4\.0", r"cc-by-4\.0"),
    ("cc-by-3.0", ("creative commons", "cc"), r"creative\s+commons\s+attribution\s+3\.0(?:\s+unported)?|cc[\s-]by\s+3\.0", r"cc-by-3\.0(?:-\w\w)?"),
    ("cc-by-2.5", ("creative commons", "cc"), r"creative\s+commons\s+attribution\s+2\.5|cc[\s-]by\s+2\.5", r"cc-by-2\.5"),
    ("cc-by-sa", ("creative commons", "cc"), r"creative\s+commons\s+attribution[\s-]+share[\s-]?alike(?:\s+\d\.\d)?|cc[\s-]by[\s-]sa(?:\s+\d\.\d)?", r"cc-by-sa(?:-\d\.\d)?"),
    ("cc-by-nc", ("creative commons", "cc"), r"creative\s+commons\s+attribution[\s-]+non[\s-]?commercial(?:\s+\d\.\d)?|cc[\s-]by[\s-]nc(?:\s+\d\.\d)?", r"cc-by-nc(?:-\d\.\d)?"),
    ("cc-by-nc-sa", ("creative commons", "cc"), r"creative\s+commons\s+attribution[\s-]+non[\s-]?commercial[\s-]+share[\s-]?alike(?:\s+\d\.\d)?|cc[\s-]by[\s-]nc[\s-]sa(?:\s+\d\.\d)?", r"cc-by-nc-sa(?:-\d\.\d)?"),
    ("cc-by-nc-nd", ("creative commons", "cc"), r"creative\s+commons\s+attribution[\s-]+non[\s-]?commercial[\s-]+no[\s-]?deriv\w*(?:\s+\d\.\d)?|cc[\s-]by[\s-]nc[\s-]nd(?:\s+\d\.\d)?", r"cc-by-nc-nd(?:-\d\.\d)?"),
    ("cc-by-nd", ("creative commons", "cc"), r"creative\s+commons\s+attribution[\s-]+no[\s-]?deriv\w*(?:\s+\d\.\d)?|cc[\s-]by[\s-]nd(?:\s+\d\.\d)?", r"cc-by-nd(?:-\d\.\d)?"),
    ("odbl", ("odbl", "open database", "open data commons"), r"open\s+(?:data\s+commons\s+)?(?:open\s+)?database\s+licen[sc]e(?:,?\s*v?1\.0)?", r"odbl(?:-1\.0)?"),
    ("odc-by", ("open data commons",), r"open\s+data\s+commons\s+attribution\s+licen[sc]e", r"odc-by(?:-1\.0)?"),
    ("pddl", ("pddl", "public domain dedication"), r"public\s+domain\s+dedication\s+and\s+licen[sc]e", r"pddl(?:-1\.0)?"),
    ("python-2.0", ("python", "psf"), r"python\s+software\s+foundation\s+licen[sc]e(?:" + V % "2" + r")?|psf\s+licen[sc]e", r"python-2\.0|psf-2\.0"),
    ("ruby", ("ruby",), r"\bruby(?:'s)?\s+licen[sc]e", r"ruby"),
    ("php-3.01", ("php",), r"\bphp\s+licen[sc]e(?:,?\s*(?:version|v\.?)?\s*3\.01)?", r"php-3\.0?1?"),
    ("perl", ("perl",), r"same\s+terms\s+as\s+perl(?:\s+itself)?", r"perl_?5?"),
    ("openssl", ("openssl",), r"openssl\s+licen[sc]e", r"openssl"),
    ("curl", ("curl",), r"\bcurl\s+licen[sc]e", r"curl"),
    ("postgresql", ("postgres",), r"postgresql\s+licen[sc]e", r"postgresql"),
    ("ofl-1.1", ("open font", "ofl"), r"(?:sil\s+)?open\s+font\s+licen[sc]e(?:,?\s*(?:version|v\.?)?\s*1\.1)?", r"ofl-?1\.[01]"),
    ("eupl-1.2", ("european union", "eupl"), r"european\s+union\s+public\s+licen[sc]e(?:,?\s*v?\.?\s*1\.2)?", r"eupl-?1\.2"),
    ("eupl-1.1", ("european union", "eupl"), r"european\s+union\s+public\s+licen[sc]e,?\s*v?\.?\s*1\.1", r"eupl-?1\.1"),
    ("upl-1.0", ("universal permissive",), r"universal\s+permissive\s+licen[sc]e(?:" + V % "1" + ")?", r"upl-?1\.0"),
    ("ms-pl", ("microsoft public",), r"microsoft\s+public\s+licen[sc]e", r"ms-pl"),
    ("ms-rl", ("microsoft reciprocal",), r"microsoft\s+reciprocal\s+licen[sc]e", r"ms-rl"),
    ("afl-3.0", ("academic free",), r"academic\s+free\s+licen[sc]e(?:" + V % "3" + ")?", r"afl-?3\.0"),
    ("osl-3.0", ("open software",), r"open\s+software\s+licen[sc]e(?:" + V % "3" + ")?", r"osl-?3\.0"),
    ("ecl-2.0", ("educational community",), r"educational\s+community\s+licen[sc]e(?:" + V % "2" + ")?", r"ecl-?2\.0"),
    ("ncsa", ("ncsa", "illinois"), r"university\s+of\s+illinois\s*/\s*ncsa\s+open\s+source\s+licen[sc]e|\bncsa\s+licen[sc]e", r"ncsa"),
    ("qpl-1.0", ("q public",), r"\bq\s+public\s+licen[sc]e", r"qpl-?1\.0"),
    ("sspl-1.0", ("server side public",), r"server\s+side\s+public\s+licen[sc]e(?:,?\s*v?1)?", r"sspl-?1\.0"),
    ("elastic-2.0", ("elastic",), r"elastic\s+licen[sc]e(?:" + V % "2" + ")?", r"elastic-?2\.0"),
    ("llama", ("llama",), r"llama\s*\d*(?:\.\d)?\s+community\s+licen[sc]e", r"llama\d?(?:\.\d)?"),
    ("openrail", ("openrail", "open rail"), r"(?:creativeml\s+)?open\s*rail(?:[+-]*\+?m)?\s+licen[sc]e", r"openrail(?:\+\+)?(?:-m)?"),
)

# Texts that name no license but are its wording, and statements without one.
WORDING = (
    ("mit", "permission is hereby granted", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy"),
    ("mit", "the software is provided", r"the\s+software\s+is\s+provided\s+(?:\"|'|“|‘)?as\s+is(?:\"|'|”|’)?,?\s+without\s+warranty\s+of\s+any\s+kind"),
    ("isc", "permission to use, copy", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose"),
    ("bsd", "redistribution and use", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,?\s+with\s+or\s+without\s+modification"),
    ("bsd-3-clause", "endorse or promote", r"may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products\s+derived"),
    ("bsd-4-clause", "advertising materials", r"all\s+advertising\s+materials\s+mentioning\s+features"),
    ("gpl", "free software foundation", r"under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public\s+licen[sc]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation"),
    ("gpl", "free software", r"this\s+program\s+is\s+free\s+software[:;,]?\s+you\s+can\s+redistribute\s+it"),
    ("apache", "unless required by applicable", r"unless\s+required\s+by\s+applicable\s+law\s+or\s+agreed\s+to\s+in\s+writing,\s+software"),
    ("mpl", "source code form", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla"),
    ("zlib", "altered source", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked"),
    ("bsl-1.0", "machine-executable", r"machine-executable\s+object\s+code\s+generated\s+by\s+a\s+source\s+language\s+processor"),
    ("unlicense", "unencumbered", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("public-domain", "public domain", r"(?:dedicated|released|placed)\s+(?:in)?to\s+the\s+public\s+domain|in\s+the\s+public\s+domain"),
    ("proprietary", "all rights reserved", r"all\s+rights\s+reserved"),
    ("proprietary", "proprietary", r"proprietary\s+and\s+confidential"),
    ("gpl", "gpl", r"\bgnu\s+gpl\b|\bgpl[\s-]+licen[sc]ed?\b"),
    ("lgpl", "lgpl", r"\bgnu\s+lgpl\b|\blgpl[\s-]+licen[sc]ed?\b"),
    ("agpl", "agpl", r"\bgnu\s+agpl\b|\bagpl[\s-]+licen[sc]ed?\b"),
    ("bsd", "bsd", r"\bbsd[\s-]+licen[sc]ed?\b"),
    ("mit", "mit", r"\bmit[\s-]+licensed\b"),
    ("apache", "apache", r"\bapache[\s-]+licensed\b"),
    ("creative-commons", "creative commons", r"creative\s+commons\s+licen[sc]e"),
    ("creative-commons", "creativecommons.org", r"creativecommons\.org/(?:licenses|publicdomain)/[\w./-]+"),
    ("gpl", "gnu.org/licenses", r"gnu\.org/(?:licenses|copyleft)/[\w./-]*"),
    ("apache", "apache.org/licenses", r"apache\.org/licenses/[\w./-]*"),
    ("mit", "opensource.org", r"opensource\.org/licenses?/mit\b"),
    ("bsd", "opensource.org", r"opensource\.org/licenses?/bsd[\w.-]*"),
)

# How a name is used: priority, confidence, expression around the name.
USES = (
    (40, 0.95, r"(?:licen[sc]ed|released|distributed|published|made\s+available|provided|available)\s+(?:to\s+you\s+)?under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:%s)"),
    (30, 0.8, r"(?:subject\s+to|governed\s+by|covered\s+by|see|terms\s+of)\s+(?:the\s+)?(?:%s)"),
    (20, 0.6, r"(?:%s)"),
)


# A name or its use starts at the start of a word: no "permit license", no "acc-by 4.0".
START = r"(?<![a-z0-9_])"


def rules():
    """All rules in order: ``(label, priority, confidence, keywords, expression)``."""
    found = []
    for label, keywords, name, short in NAMES:
        for priority, confidence, use in USES:
            found.append((label, priority, confidence, keywords, START + "(?:" + use % name + ")"))
        spoken = short.replace("-?v?", r"[\s-]?v?\.?\s?")
        found.append((label, 38, 0.9, ("licen",), START + r"licen[sc]ed\s+under\s+(?:the\s+)?(?:gnu\s+)?(?:%s)(?![\w-]|\.\w)" % spoken))
        if "gpl" in short:
            found.append((label, 18, 0.6, ("gpl",), START + r"(?:gnu\s+)?(?:%s)(?![\w-]|\.\w)" % spoken))
        found.append((label, 50, 1.0, ("spdx-license-identifier",), r"spdx-license-identifier:[ \t]*(?:%s)(?![\w.-])" % short))
        found.append((label, 35, 0.85, ("licen",), r"\blicen[sc]es?[\"']?\s*[:=]\s*[\[\"'{(]*\s*(?:%s)(?![\w.-])" % short))
    for label, keyword, expression in WORDING:
        found.append((label, 25, 0.7, (keyword,), expression))
    return found


NOT_WORD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class Scanner:
    """The compiled rules; rules that share keywords are gated by one look."""

    def __init__(self, ordered=None):
        self.gates = {}
        for order, (label, priority, confidence, keywords, expression) in enumerate(ordered or rules()):
            self.gates.setdefault(tuple(k.encode() for k in keywords), []).append(
                (order, label, priority, confidence, re.compile(expression.encode())))
        self.lower = X.lower_table()

    def base(self, words):
        """``(phrase, label, first word)`` of every place of a base phrase."""
        joined = b" " + b" ".join(words) + b" "
        found = []
        for phrase, label in BASE:
            wanted = b" " + phrase.encode() + b" "
            at, counted, word = joined.find(wanted), 0, 0
            while at >= 0:
                word += joined.count(b" ", counted, at)
                counted = at
                found.append((phrase, label, word))
                at = joined.find(wanted, at + 1)
        return found

    def detections(self, lowered: bytes):
        """Detections that stay, by place: ``(start, end, label, priority, confidence)``.

        Swept by start, then from the longest: one is suppressed if an earlier one
        of the same or a higher priority reaches as far. Of equal spans the higher
        priority, then the earlier rule stays.
        """
        found = []
        flat = b" ".join(lowered.split())  # white space as the expressions' \\s+ takes it
        for keywords, gated in self.gates.items():
            if any(k in flat for k in keywords):
                for order, label, priority, confidence, expression in gated:
                    found += [(m.start(), -m.end(), -priority, order, label, confidence)
                              for m in expression.finditer(lowered)]
        found.sort()
        reach, kept = {}, []
        for start, end, priority, _, label, confidence in found:
            if any(p <= priority and e >= -end for p, e in reach.items()):
                continue
            reach[priority] = max(reach.get(priority, 0), -end)
            kept.append((start, -end, label, -priority, confidence))
        return kept

    def scan(self, data: bytes):
        """``n_words``, base places and detections of one text."""
        lowered = data.translate(self.lower)
        words = lowered.translate(NOT_WORD).split()
        base = self.base(words) if b"licen" in lowered or b"cc" in lowered else []
        return len(words), base, self.detections(lowered)


COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                     ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Words are runs of ASCII letters and digits and of any other character above
    ASCII, after lower-casing A-Z. ``labels`` joins the base labels and those of
    the detections that stay; ``score`` is the highest confidence among them, a
    base phrase counting 0.6, and 0 without any. Null and empty texts have no
    words, null places, empty label strings and score 0. A null doc_id stays
    null; repeated rows each get a row; other columns are ignored.
    """
    def scanned(batches):
        scanner = Scanner()
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), X.binary_column(batch, "text")):
                n, base, kept = scanner.scan(data)
                places = [w for _, _, w in base]
                own = {label for _, label, _ in base}
                rows.append((doc_id, n, len(base), min(places, default=None), max(places, default=None),
                             ",".join(sorted(own)), ",".join(sorted(own | {k[2] for k in kept})),
                             max([0.6 * bool(base), *(k[4] for k in kept)])))
            columns = list(zip(*rows)) if rows else [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COLUMNS)], schema=COLUMNS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                    "base_labels string, labels string, score double")


def detections(docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, label, priority, confidence, span``: the detections that stay, by byte position."""
    def found(batches):
        scanner = Scanner()
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), X.binary_column(batch, "text")):
                rows += [(doc_id, a, b - a, label, priority, confidence, data[a:b].decode("utf-8", "replace"))
                         for a, b, label, priority, confidence in scanner.detections(data.translate(scanner.lower))]
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "start", "length", "label", "priority", "confidence", "span"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(found, "doc_id long, start long, length long, label string, priority long, "
                                  "confidence double, span string")
