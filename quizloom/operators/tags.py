"""Keyword tags: a fixed table of substrings, found in each question's texts in one pass.

Keywords match anywhere, inside words too. Null texts and malformed JSON count as empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.functions import items as I
from quizloom.sources.tables import spread

# Tags and the substrings that suggest them.
KEYWORDS: dict[str, list[str]] = {
    "tcp": ["tcp", "three-way", "window", "ack"],
    "udp": ["udp", "datagram"],
    "dns": ["dns", "domain name", "resolver"],
    "http": ["http", "https", "request", "response", "rest"],
    "smtp": ["smtp", "mail transfer"],
    "dhcp": ["dhcp", "lease"],
    "icmp": ["icmp", "ping"],
    "ipv4": ["ipv4", "32 bit"],
    "ipv6": ["ipv6", "128 bit"],
    "ethernet": ["ethernet", "mac address", "switch"],
    "routing": ["routing", "ospf", "rip", "bgp", "router"],
    "nat": ["nat", "masquerading"],
    "subnetting": ["subnet", "cidr", "netmask"],
    "arq": ["go-back-n", "stop-and-wait", "arq", "selective repeat"],
    "tls": ["tls", "ssl", "certificate", "handshake"],
    "firewall": ["firewall", "packet filtering"],
    "sicurezza": ["sicurezza", "security", "attacco", "mitm"],
    "introduzione-reti": ["internet", "rete", "network", "protocollo"],
    "internet-ict-protocolli": ["ict", "protocollo", "protocol"],
    "architettura-livelli": ["livello", "layer", "architettura a livelli"],
    "pila-protocolli-internet": ["applicazione", "trasporto", "rete", "collegamento", "fisico", "stack"],
    "incapsulamento": ["incapsulamento", "segmento", "datagramma", "frame"],
    "network-edge": ["network edge", "periferia della rete"],
    "host-sistemi-periferici": ["host", "sistema periferico", "end system"],
    "reti-accesso": ["rete di accesso", "accesso residenziale", "accesso mobile"],
    "mezzi-trasmissivi": ["mezzo trasmissivo", "fibra", "rame", "wireless", "propagazione"],
    "network-core": ["network core", "nucleo della rete"],
    "router-inter-reti": ["router", "inter-rete", "internetwork"],
    "commutazione-circuito": ["commutazione di circuito", "circuit switching"],
    "fdm": ["fdm", "divisione di frequenza"],
    "tdm": ["tdm", "divisione di tempo"],
    "commutazione-pacchetto": ["commutazione di pacchetto", "packet switching"],
    "store-and-forward": ["store-and-forward", "store and forward"],
    "struttura-internet": ["struttura di internet", "internet structure"],
    "gerarchia-reti-isp": ["gerarchia", "isp", "provider"],
    "isp-tier-1": ["tier-1", "tier 1"],
    "ixp": ["ixp", "internet exchange point"],
    "content-provider-networks": ["content provider", "cdn", "google network"],
    "prestazioni-rete": ["prestazioni", "performance"],
    "ritardi-nodali": ["ritardo", "accodamento", "propagazione", "trasmissione", "elaborazione"],
    "throughput": ["throughput"],
    "bottleneck": ["bottleneck", "collo di bottiglia"],
    "adsl": ["adsl", "asymmetric digital subscriber line"],
    "dsl": ["dsl", "dslam", "splitter", "dsl modem", "linea telefonica"],
    "fttx": ["fttx", "ftth", "fttc", "fttb"],
    "hfc": ["hfc", "hybrid fiber coax"],
    "csma": ["csma", "carrier sense multiple access"],
    "osi": ["iso/osi", "osi", "livello applicazione", "livello trasporto", "livello rete", "livello collegamento"],
}
# The tag every question has with its score, and the score of matches in hundredths.
ALWAYS, ALWAYS_SCORE = "reti", 50
FIRST, EACH, MOST = 55, 15, 100
# The shorter map used on stems alone.
STEM_KEYS = {
    "tcp": "tcp", "udp": "udp", "dns": "dns", "http": "http", "smtp": "smtp", "dhcp": "dhcp", "icmp": "icmp",
    "ipv4": "ipv4", "ipv6": "ipv6", "ethernet": "ethernet", "go-back-n": "arq", "stop-and-wait": "arq", "routing": "routing",
}
#: Example presets: named sets of tags.
PRESETS = {"transport": ["tcp", "udp", "arq"], "names": ["dns", "dhcp"], "web": ["http", "tls", "throughput"]}


def blob(stem: Column, options_json: Column, subparts_json: Column) -> Column:
    """Stem, option texts and subpart prompts in lower case, joined by blanks."""
    options, subparts = I.decoded(options_json, I.OPTIONS)["text"], I.decoded(subparts_json, I.SUBPARTS)["prompt"]
    return F.lower(F.concat_ws(" ", F.coalesce(stem, F.lit("")), F.concat_ws(" ", options), F.concat_ws(" ", subparts)))


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, slug, hundredths) of the tags of each text: one pass over it finds all keywords, overlapping ones too."""
    import ahocorasick

    automaton, tags = ahocorasick.Automaton(), {}
    for slug, keys in KEYWORDS.items():
        for key in dict.fromkeys(keys):
            tags.setdefault(key, []).append(slug)
    for key, slugs in tags.items():
        automaton.add_word(key, (key, slugs))
    automaton.make_automaton()
    for batch in batches:
        rows, slugs, scores = [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            count = Counter(slug for _, own in {key: own for _, (key, own) in automaton.iter(text)}.items() for slug in own)
            rows += [row] * (len(count) + 1)
            slugs += [*count, ALWAYS]
            scores += [*(min(MOST, FIRST + EACH * n) for n in count.values()), ALWAYS_SCORE]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(slugs, pa.string()), pa.array(scores, pa.int32())], ["id", "slug", "hundredths"])


def rule_tags(questions: DataFrame) -> DataFrame:
    """(id, slug, score): one row per tag of a question; score is min(1, .55 + .15 per keyword found).

    Keywords are found in Arrow batches by one automaton for all of them: as JVM expressions they take a search each.
    """
    own = questions.select(F.col("id").cast("string").alias("id"), blob(F.col("stem"), F.col("options_json"), F.col("subparts_json")).alias("blob"))
    return spread(own).mapInArrow(_hits, "id string, slug string, hundredths int").select("id", "slug", (F.col("hundredths") / 100).cast("decimal(3,2)").alias("score"))


def parser_tags(stem: Column) -> Column:
    """Sorted tags by the shorter map."""
    low = F.lower(F.coalesce(stem, F.lit("")))
    own = F.array(F.lit(ALWAYS), *[F.when(F.contains(low, F.lit(k)), F.lit(tag)) for k, tag in STEM_KEYS.items()])
    return F.array_sort(F.array_distinct(F.array_compact(own)))


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, s) for p, slugs in PRESETS.items() for s in slugs], "preset string, slug string")


def sql_presets() -> str:
    return "(VALUES " + ", ".join(f"('{p}', '{s}')" for p, slugs in PRESETS.items() for s in slugs) + ") AS presets(preset, slug)"


def _sql_list(json: str, field: str) -> str:
    return f"array_to_string(list_transform(CASE WHEN json_valid({json}) AND json_type({json}) = 'ARRAY' THEN from_json({json}, '[{{\"id\":\"VARCHAR\",\"{field}\":\"VARCHAR\"}}]') ELSE [] END, lambda x: x.{field}), ' ')"


def sql_rule_tags() -> str:
    keys = ", ".join(f"('{slug}', '{k}')" for slug, ks in KEYWORDS.items() for k in ks)
    return f"""SELECT id, slug, (least({MOST}, {FIRST} + {EACH} * count(*)) / 100.0)::DECIMAL(3,2) AS score
FROM (SELECT id, lower(concat_ws(' ', coalesce(stem, ''), {_sql_list('options_json', 'text')}, {_sql_list('subparts_json', 'prompt')})) AS b FROM questions) JOIN (VALUES {keys}) AS k(slug, word) ON contains(b, word) GROUP BY id, slug
UNION ALL SELECT id, '{ALWAYS}', 0.50::DECIMAL(3,2) FROM questions"""


def sql_parser_tags() -> str:
    cases = ", ".join(f"CASE WHEN contains(lower(stem), '{k}') THEN '{tag}' END" for k, tag in STEM_KEYS.items())
    return f"SELECT id, array_to_string(list_sort(list_distinct(['{ALWAYS}', {cases}])), ',') AS tags FROM questions"
