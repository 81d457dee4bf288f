"""Policy: the weights, word lists and limits that the jobs take as inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Topic terms (normalised) and their weights; scores add up and are capped at 100.
TOPIC_WEIGHTS = (
    ("gestao socioambiental", 35),
    ("ciencias ambientais", 30),
    ("ciencias ambientais e conservacao", 10),
    ("desenvolvimento sustentavel", 30),
    ("gestao ambiental", 28),
    ("sustentabilidade", 25),
    ("administracao publica", 24),
    ("gestao de politicas publicas", 24),
    ("politicas publicas", 22),
    ("administracao", 22),
    ("gestao publica", 22),
    ("responsabilidade social", 20),
    ("economia ambiental", 20),
    ("desenvolvimento territorial", 18),
    ("planejamento territorial", 18),
    ("desenvolvimento regional", 17),
    ("desenvolvimento local", 16),
    ("governanca", 15),
    ("empreendedorismo", 15),
    ("inovacao", 15),
    ("gestao de projetos", 15),
    ("estrategia", 14),
    ("planejamento", 13),
    ("desenvolvimento", 10),
    ("gestao", 12),
    ("multidisciplinar", 10),
    ("interdisciplinar", 10),
    ("esg", 12),
)
#: Words in names of institutions and notices that tell the institution's type.
HIGHER_NAMES = (
    "universidade", "instituto federal", "cefet", "faculdade", "centro universitario", "ensino superior",
    "escola politecnica", "colegio pedro ii", "fundacao universidade",
)
BASIC_NAMES = (
    "prefeitura", "municipio", "secretaria municipal", "secretaria de educacao", "secretaria da educacao",
    "secretaria estadual de educacao", "camara", "consorcio", "saae", "instituto de previdencia",
)
HIGHER_ONLY_WORDS = (
    "magisterio superior", "ensino superior", "ebtt", "professor visitante", "professor titular", "professor doutor",
    "docente do ensino superior", "educacao basica, tecnica e tecnologica", "pos-graduacao stricto sensu",
)
#: Fixed value: shape of a university's acronym, in the name as written.
ACRONYM = r"\b(?:U[FE][A-Z]{1,4}|IF[A-Z]{1,4}|UNI[A-Z]{2,6}|UTFPR|USP|UNB)\b"
#: Priority of states; all others have 4.
STATE_PRIORITY = (("BA", 1), ("PR", 2), ("SC", 3), ("RS", 3))
#: Hosts, first host labels and paths of links that never lead to a document.
EXCLUDED_DOMAINS = (
    "twitter.com", "x.com", "facebook.com", "linkedin.com", "whatsapp.com", "instagram.com", "threads.com",
    "youtube.com", "youtu.be", "t.me", "tiktok.com", "bsky.app", "pinterest.com", "flickr.com", "linktr.ee",
    "mastodon.social", "telegram.me",
)
EXCLUDED_LABELS = ("podcast", "jornal", "radio", "tv", "blog", "agencia", "webmail")
EXCLUDED_PATHS = (
    "/login", "/signin", "/cadastro", "/senha", "/minha-conta", "/busca", "/search", "/sitemap", "/rss", "/feed",
    "/fale-conosco", "/contato", "/podcast",
)
LATE_WORDS = (
    "noticia", "noticias", "agenda", "evento", "imprensa", "midia", "legislacao", "portaria", "decreto", "galeria", "webmail",
)
#: Tracked fields of a notice and the label of a change in each.
CHANGE_LABELS = (
    ("title", "título alterado"),
    ("salary_text", "remuneração alterada"),
    ("registration_start", "início das inscrições alterado"),
    ("registration_end", "prazo alterado"),
    ("graduation_requirement_raw", "requisito de graduação alterado"),
    ("masters_requirement_raw", "requisito de mestrado alterado"),
    ("doctorate_requirement_raw", "requisito de doutorado alterado"),
    ("postgraduate_requirement_raw", "requisito de pós-graduação alterado"),
)
CONTENT_CHANGED = "conteúdo alterado"

CLOSING_DAYS, CLOSED_VISIBLE_DAYS = 7, 30
RECHECK_DAYS, RECHECK_CLOSING_DAYS = 14, 10
READER_VERSION, DOCUMENT_RECHECK_DAYS, RETRY_DAYS = 10, 14, 1
HISTORY, RUNS = 20, 365
VISITS, DEPTH = 12, 2
STRONG_YES, STRONG_UNCERTAIN = 60, 75
DEFAULT_PRIORITY = 4


def weights_table(spark: SparkSession, terms: Sequence[tuple[str, int]] = TOPIC_WEIGHTS) -> DataFrame:
    """(term, weight, position) as a table; a policy list has a fixed size."""
    return spark.createDataFrame([(t, w, i) for i, (t, w) in enumerate(terms)], "term string, weight int, position int")
