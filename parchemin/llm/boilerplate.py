"""Page boilerplate by template deduction from equivalence classes (problem 4).

A line is cut into cells at menu marks; its token is its cells with numbers and
names made alike.  Within one host, tokens that share their occurrence vector
over the pages form an equivalence class; a class is valid if it is large and
frequent enough and its tokens stand in the same order on every page, and a
class of one token if it is on a large share of the pages and stands by other
class tokens or a page's edge.  Tokens of valid
classes, and lines most of whose cells are such tokens, start the template.

Further tokens are nested into it by where they stand.  The score of a
recurring token that is no sentence is the mean of its neighbours': one for the
template and a page's edge, zero for sentences, their own score for other
recurring tokens, and it is settled in rounds.  A token that scores enough is
nested.  Slots are typed by what stands around them: a token that leads from
the template into sentences is a title, one that is followed by runs of titles
heads a list of links, and titles in such a list are links while the others are
body.  Sentences outside valid classes are always body.

Fixed word lists in four languages (cookie notices, menus, offers) supplement
the template where a page's furniture recurs too seldom to be deduced;
``told_by`` says which way a line was found.

Occurrence vectors are two exclusive-or hashes of page ids, so a line on every
page costs one row after the map side, and no vector is ever collected; scores
are settled on the table of neighbouring tokens with their counts.

Defined results: blank lines are never reported; a null text or path gives no
lines to the word lists alone (a null path is a host of its own); pages without
furniture or without body are handled like others; repeated rows of a page
count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint, measured
from .sitelines import site_of
from .split import WHITE

#: A class holds at least so many lines, on so many pages and this share of the host's pages.
CLASS_LINES, CLASS_PAGES, CLASS_SHARE = 2, 4, 0.01
#: A class may be a single token on this share of the host's pages; a line is of the template if this share of its cells, and at least two, are.
ALONE_SHARE, CELLS_SHARE = 0.15, 0.6
#: A token recurs if it stands so often; it is nested from this score on, which is settled in so many rounds.
RECURRING, NESTED, ROUNDS = 4, 0.28, 6
#: A title leads into sentences in this share of its occurrences; a heading of links stands so often and is followed by that many titles on average.
LEADS, HEADINGS, FOLLOWED = 0.15, 8, 2.0

# What furniture says in the corpus's four languages; whole lines unless the pattern ends in ".*".
RELATED = re.compile(
    r"(?i)^(dernières (publications|actualités|nouvelles)|les plus (consultés|lus|récents)|nos (rendez-vous|événements|dossiers)|(à )?lire aussi|voir aussi|sur le même (thème|sujet)|articles? (liés|similaires|récents)|à (découvrir|voir) aussi|dans la même rubrique"
    r"|most (read|viewed|popular)|read also|see also|also read|on the same topic|related (articles|pages|content)|(latest|recent) (publications|news|articles)|(our|upcoming) events|you may also like"
    r"|meistgelesen|lesen sie auch|siehe auch|zum (gleichen )?thema|(neueste|aktuelle) (veröffentlichungen|meldungen|beiträge)|unsere termine|das könnte sie auch interessieren"
    r"|lo más (leído|visto)|lea también|lee también|ver también|sobre el mismo tema|(últimas|recientes) (publicaciones|noticias)|nuestras citas|artículos relacionados)\s*:?$"
)
LINKS = re.compile(r"(?i)^(lire aussi|à lire|voir aussi|notre dossier|dossier|à découvrir|read also|see also|our file|related|lesen sie auch|siehe auch|unser dossier|lea también|nuestro dossier|ver también)\s?:\s*\S.*$")
SEE_BODY = re.compile(r"[.;]$")
OFFERS = re.compile(
    r"(?i)^(publicité|annonce|sponsorisé|advertisement|sponsored|anzeige|werbung|publicidad|offre d'essai.*|offre (spéciale|découverte).*|inscription au webinaire.*|essai gratuit.*|free trial.*|(register|sign up|registration) (for|to) the webinar.*|webinar.*(places|seats).*|kostenlose.* test.*|testangebot.*|prueba gratuita.*|oferta de prueba.*|inscripción al (seminario|webinar).*)$"
)
NOTICES = re.compile(
    r"(?i)^(ce site (dépose|utilise) .*|en poursuivant votre navigation.*|nous respectons vos choix.*|pour financer .* (annonceurs|partenaires) .*|.* et ses \d+ partenaires utilisent .*|this site uses .*|by (browsing on|continuing).*|.* and its \d+ partners use cookies.*|to fund .* advertisers .*|we (value|respect) your (privacy|choices).*"
    r"|diese (website|seite) (verwendet|setzt|nutzt) .*|.* und (seine|ihre) \d+ partner (verwenden|nutzen).*|este sitio (utiliza|usa) .*|.* y sus \d+ socios (usan|utilizan).*|al (continuar|seguir) navegando.*"
    r"|gestion de vos préférences|cookies nécessaires.*|mesure d'audience\s?:.*|publicité\s?: (dés)?activée?|traceurs\s?: .*|enregistrer mes choix|personnaliser|(tout )?(accepter|refuser)|j'accepte|continuer sans accepter|voir nos \d+ fournisseurs|ok, j'ai compris"
    r"|manage your (preferences|choices)|necessary cookies.*|audience measurement\s?:.*|advertising\s?: (on|off|enabled|disabled)|trackers\s?: .*|save my choices|customi[sz]e|(accept|reject) all|i accept|continue without accepting|see our \d+ vendors|ok, got it"
    r"|alle (akzeptieren|ablehnen)|anpassen|ich stimme zu|auswahl speichern|aceptar todo|rechazar todo|personalizar|acepto)$"
)
TOOLS = re.compile(
    r"(?i)^(menu|fermer le menu|aller au contenu( principal)?|se connecter|rechercher dans le site|taille du texte.*|haut de page|version mobile|flux d'actualités|contact|données personnelles|marchés publics|mentions légales.*|politique de confidentialité.*|suivez-nous.*|©.*|tous droits réservés.*|site réalisé par .*|.* standard ouvert de \d.*|plan du site"
    r"|partager\s?:.*|écouter cet article.*|votre adresse électronique.*|\d+ (réactions?|commentaires?) – .*|connectez-vous pour .*|recevoir une alerte .*|abonnez-vous .*|vous aimez cet article.*|répondez à notre enquête.*|imprimer|fr \| en"
    r"|close menu|skip to( main)? content|log in|sign in|search this site|text size.*|back to top|mobile version|news feed|privacy( policy.*)?|personal data|legal notice.*|follow us.*|all rights reserved.*|site (built|made|designed) by .*|.*switchboard open \d.*|site map|public tenders"
    r"|share\s?:.*|listen to this article.*|your e-?mail\s?:.*|\d+ comments? – .*|log in to .*|get an alert .*|subscribe to .*|(do )?you like this article.*|answer our .*survey.*|take our .*survey.*|print"
    r"|menü( schließen)?|zum inhalt( springen)?|anmelden|suche auf dieser seite|nach oben|impressum.*|datenschutz(erklärung)?|kontakt|folgen sie uns.*|alle rechte vorbehalten.*|teilen\s?:.*|artikel anhören.*|abonnieren sie .*|\d+ kommentare – .*"
    r"|cerrar (el )?menú|ir al contenido( principal)?|iniciar sesión|buscar en el sitio|volver arriba|aviso legal.*|privacidad|contacto|síganos.*|todos los derechos reservados.*|compartir\s?:.*|escuchar este artículo.*|suscríbase .*|\d+ comentarios – .*)$"
)
#: Menu entries, as cells of a menu line or lines of their own.
ENTRIES = re.compile(
    r"(?i)^(accueil|actualités|agenda|annuaire|carrières|contrôles|décisions|dossiers|espace presse|fiches pratiques|formations|glossaire|mon espace|outils|partenaires|publications|questions fréquentes|thématiques|recrutement|contact"
    r"|home|news|calendar|careers|inspections|decisions|topics|press room|guides|training|glossary|my account|tools|partners|faq|about us|directory"
    r"|startseite|aktuelles|termine|karriere|kontrollen|entscheidungen|themen|presse|leitfäden|schulungen|glossar|mein konto|werkzeuge|partner|veröffentlichungen|häufige fragen"
    r"|inicio|noticias|empleo|inspecciones|decisiones|temas|sala de prensa|guías|formación|glosario|mi cuenta|herramientas|socios|publicaciones|preguntas frecuentes)$"
)
CELLS = re.compile(r"\s+[•·>›/»|]\s+|\s{2,}")
PATH = re.compile(r"(?i)^(accueil|home|startseite|inicio)\s+[›>/»→|]\s+\S")
ITEM = re.compile(r"^\s*([-*•–◦]|\d{1,3}[.)])\s+\S")
ROW = re.compile(r"^[^|]+( \| [^|]+)*\s*\|\s*[\d.,]+\s*(\||$)|^\|")


def is_title(line: str) -> bool:
    """Form of a title or link: no full stop, neither item nor table row."""
    return line[-1] not in ".;:!" and not ITEM.match(line) and not ROW.match(line)


def is_furniture(line: str) -> bool:
    """Whether the slot's own words make it furniture."""
    if NOTICES.match(line) or TOOLS.match(line) or OFFERS.match(line) or ENTRIES.match(line) or PATH.match(line):
        return True
    if LINKS.match(line) and not SEE_BODY.search(line):
        return True
    cells = CELLS.split(line)
    return len(cells) >= 2 and all(c and (ENTRIES.match(c) or TOOLS.match(c) or NOTICES.match(c)) for c in cells)


def listed_lines(lines: list[str]) -> list[int]:
    """Numbers (from 1) of the non-blank lines that the word lists tell."""
    found, links = [], False
    for number, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line:
            continue
        if RELATED.match(line):
            links = True
        elif not is_furniture(line) and not (links and is_title(line)):
            links = False
            continue
        found.append(number)
    return found


# Forms of lines, as Java patterns.
CELL_MARKS = r"\s+[•·>›/»|→–]\s+"
NAMES = r"(?<=\s)[(«\"]?(?:\p{L}['’])?\p{Lu}\S*"
SENTENCE = r"[.!?…;,:]$"
LISTED = r"^([-*•–◦]|\d{1,3}[.)])\s+\S|^\|"


def _token(cell: Column) -> Column:
    """A cell with numbers and names made alike."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cell, r"\p{Nd}+", "0"), NAMES, "_"), r"_(?:\s+_)+", "_")


def _line(raw: Column, number: Column) -> Column:
    """Struct of a line: number, token u, whether it is a sentence or list item, cells where it has several, prefix and rest where it has a colon; blank lines have an empty text."""
    text = F.trim(F.regexp_replace(raw, f"[{WHITE}]+", " "))
    cells = F.transform(F.split(text, CELL_MARKS), _token)
    rest = F.trim(F.regexp_extract(text, r"^[^:]*:\s*(.*)$", 1))
    return F.struct(
        number.alias("line_no"), (text == "").alias("blank"), F.xxhash64(F.array_join(cells, " · ")).alias("u"),
        ((text.rlike(SENTENCE) & (F.size(F.split(text, " ")) >= 6)) | text.rlike(LISTED)).alias("sent"),
        F.when(F.size(cells) > 1, F.transform(cells, lambda c: F.xxhash64(c))).alias("cells"),
        F.when(rest != "", F.xxhash64(_token(F.trim(F.substring_index(text, ":", 1))))).alias("prefix"), F.when(rest != "", F.xxhash64(_token(rest))).alias("rest"),
    )


def page_arrays(pages: DataFrame) -> DataFrame:
    """(page_id, site, lines): the non-blank lines of each page, in order."""
    numbered = F.transform(F.split("text", "\n"), lambda x, k: _line(x, (k + 1).cast("int")))
    return pages.select("page_id", F.coalesce(site_of(F.col("document_path")), F.lit("")).alias("site"), F.filter(numbered, lambda x: ~x["blank"]).alias("lines"))


def neighboured(arrays: DataFrame) -> DataFrame:
    """One row for each line: page_id, site, ord, its fields, and token and form of the lines before and after it (null at a page's edge)."""
    lines = F.col("lines")

    def placed(x: Column, k: Column) -> Column:
        before, after = F.get(lines, k - 1), F.get(lines, k + 1)
        return F.struct(k.alias("ord"), x.alias("x"), before["u"].alias("pu"), before["sent"].alias("ps"), after["u"].alias("nu"), after["sent"].alias("ns"))

    return arrays.select("page_id", "site", F.explode(F.transform(lines, placed)).alias("y")).select("page_id", "site", "y.ord", "y.x.line_no", "y.x.u", "y.x.sent", "y.x.cells", "y.x.prefix", "y.x.rest", "y.pu", "y.ps", "y.nu", "y.ns", F.xxhash64("site", "y.x.u").alias("h"))


def template_classes(lines: DataFrame) -> DataFrame:
    """(site, h, u, class, alone): tokens of the valid equivalence classes; ``alone`` marks classes of one token."""
    totals = lines.select("site", "page_id").distinct().groupBy("site").agg(F.count("*").alias("n_pages"))
    vectors = lines.select("site", "h", "u", "page_id").distinct().groupBy("site", "h", "u").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("page_id")).alias("v"), F.bit_xor(F.xxhash64(F.lit("page"), "page_id")).alias("w"))
    frequent = checkpoint(vectors.where(F.col("n") >= CLASS_PAGES).join(broadcast_if_small(totals), "site").where(F.col("n") >= F.col("n_pages") * F.lit(CLASS_SHARE)).withColumn("class", F.xxhash64("site", "n", "v", "w")))
    alone = frequent.where(F.col("n") >= F.col("n_pages") * F.lit(ALONE_SHARE)).select("site", "h", "u", "class", F.lit(True).alias("alone"))
    large = frequent.groupBy("class").agg(F.count("*").alias("n_lines")).where(F.col("n_lines") >= CLASS_LINES).select("class")
    members = broadcast_if_small(frequent.join(large.hint("merge"), "class", "left_semi").select("site", "h", "u", "class"))
    # Same order everywhere: the first occurrences of a class's tokens, in page order, hash alike on all its pages.
    first = lines.select("h", "page_id", "ord").join(members, "h").groupBy("class", "page_id", "h").agg(F.min("ord").alias("ord"))
    order = first.groupBy("class", "page_id").agg(F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("ord", "h"))), lambda x: x["h"])).alias("order"))
    ordered = order.groupBy("class").agg(F.min("order").alias("a"), F.max("order").alias("b")).where("a = b").select("class")
    return members.join(ordered.hint("merge"), "class", "left_semi").select("site", "h", "u", "class", F.lit(False).alias("alone")).unionByName(alone)


def of_known_cells(cells: DataFrame, known: DataFrame) -> DataFrame:
    """(u): tokens of several cells (u, cell, of) most of which are in ``known`` (u)."""
    held = cells.join(known.withColumnRenamed("u", "cell"), "cell", "left_semi").groupBy("u", "of").agg(F.sum("k").alias("n"))
    return held.where((F.col("n") >= 2) & (F.col("n") >= F.col("of") * F.lit(CELLS_SHARE))).select("u")


def settled_scores(near: DataFrame, known: DataFrame, recurring: DataFrame, small: bool) -> DataFrame:
    """(u, score) of the recurring tokens, from the counted neighbours (u, v, vs, k) and the tokens known to be of the template; ``small``: the recurring tokens have been measured and may be broadcast."""
    hint = "broadcast" if small else "merge"
    marked = checkpoint(near.join(known.withColumnsRenamed({"u": "v"}).withColumn("t", F.lit(True)), "v", "left").withColumn("t", F.coalesce("t", F.isnull("v"))))
    fixed = marked.groupBy("u").agg(F.sum(F.when(F.col("t"), F.col("k")).otherwise(0)).alias("one"), F.sum(F.when(F.col("vs") & ~F.col("t"), F.col("k")).otherwise(0)).alias("zero"))
    free = checkpoint(marked.where("NOT t AND NOT vs").select("u", "v", "k").join(recurring.select(F.col("u").alias("v")).hint(hint), "v", "left_semi"))
    weight = free.groupBy("u").agg(F.sum("k").alias("free"))
    fixed = checkpoint(fixed.join(weight.hint("merge"), "u", "left").select("u", "one", (F.col("one") + F.col("zero") + F.coalesce("free", F.lit(0))).alias("of")).where("of > 0"))
    scores = fixed.select("u", F.lit(0.5).alias("score"))
    for _ in range(ROUNDS):
        around = free.join(scores.withColumnRenamed("u", "v").hint(hint), "v").groupBy("u").agg(F.sum(F.col("k") * F.col("score")).alias("around"))
        scores = fixed.join(around.hint(hint), "u", "left").select("u", ((F.col("one") + F.coalesce("around", F.lit(0.0))) / F.col("of")).alias("score"))
    return scores


def template_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of the lines that the deduced template holds, without any word list."""
    lines = neighboured(checkpoint(page_arrays(pages)))
    recurring, small = measured(lines.where("NOT sent").groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= RECURRING))
    open_lines = lines.where("NOT sent").join(recurring.hint("broadcast" if small else "merge"), "u")
    classes = broadcast_if_small(template_classes(lines).groupBy("u").agg(F.min("alone").alias("alone")))
    seen = lines.join(broadcast_if_small(recurring.select("u").union(classes.select("u")).distinct()), "u", "left_semi")
    near = seen.select("u", F.explode(F.array(F.struct(F.col("pu").alias("v"), F.col("ps").alias("vs")), F.struct(F.col("nu").alias("v"), F.col("ns").alias("vs")))).alias("x"))
    near = checkpoint(near.groupBy("u", "x.v", F.coalesce("x.vs", F.lit(False)).alias("vs")).agg(F.count("*").alias("k")))
    # A token alone in its class must stand by other class tokens or a page's edge, as a heading that recurs in the body does not.
    held = near.join(classes.select("u", "alone"), "u").join(classes.select(F.col("u").alias("v"), F.lit(1).alias("by")), "v", "left").groupBy("u", "alone").agg(F.sum(F.when(F.isnull("v"), F.col("k")).otherwise(F.col("k") * F.coalesce("by", F.lit(0)))).alias("held"), F.sum("k").alias("of"))
    classes = checkpoint(held.where(~F.col("alone") | (F.col("held") >= F.col("of") * F.lit(NESTED))).select("u"))
    near = near.join(recurring.select("u").hint("broadcast" if small else "merge"), "u", "left_semi")
    leading = checkpoint(open_lines.where("ns AND NOT coalesce(ps, false)").groupBy("u", "n", F.col("nu").alias("v")).agg(F.count("*").alias("k")))
    several = lines.where("cells IS NOT NULL").select("u", F.explode("cells").alias("cell"), F.size("cells").alias("of")).groupBy("u", "of", "cell").agg(F.count("*").alias("k"))
    # Each line of a token holds the same cells, so a cell counts as often as it stands in one of them.
    times = lines.where("cells IS NOT NULL").groupBy("u").agg(F.count("*").alias("n"))
    several = checkpoint(several.join(times.hint("merge"), "u").select("u", "of", "cell", (F.col("k") / F.col("n")).alias("k")))
    headings = None
    for last in (False, True):
        own = classes if headings is None else classes.union(headings).distinct()
        known = broadcast_if_small(own.union(of_known_cells(several, own)).distinct())
        nested = settled_scores(near, known, recurring, small).where(F.col("score") >= NESTED).select("u")
        held = known.union(nested).distinct()
        held = broadcast_if_small(held.union(of_known_cells(several, held)).distinct() if last else held)
        leads = leading.join(held.withColumnRenamed("u", "v"), "v", "left_anti").groupBy("u", "n").agg(F.sum("k").alias("k"))
        titles = broadcast_if_small(leads.where(F.col("k") >= F.col("n") * F.lit(LEADS)).select("u"))
        told = lines.select("page_id", "ord", "line_no", "u", "sent", "prefix", "rest").join(held.withColumn("t", F.lit(True)), "u", "left").join(titles.withColumn("title", F.lit(True)), "u", "left")
        told = told.withColumn("t", F.coalesce("t", F.lit(False))).withColumn("title", F.coalesce("title", F.lit(False)))
        told = told.withColumn("open", ~F.col("sent") & (F.col("title") | ~F.col("t")))
        page = Window.partitionBy("page_id").orderBy("ord")
        if not last:
            after = page.rowsBetween(1, Window.unboundedFollowing)
            run = F.coalesce(F.min(F.when(~F.col("open"), F.col("ord"))).over(after) - 1, F.max("ord").over(after), F.col("ord")) - F.col("ord")
            runs = told.withColumn("run", run).where("NOT sent AND NOT title").groupBy("u").agg(F.count("*").alias("n"), F.avg("run").alias("run"))
            headings = checkpoint(runs.where((F.col("n") >= HEADINGS) & (F.col("run") >= FOLLOWED)).select("u"))
    headed = told.join(broadcast_if_small(headings).withColumn("heading", F.lit(True)), "u", "left").withColumn("heading", F.coalesce("heading", F.lit(False)))
    pointing = lines.where("rest IS NOT NULL").select("prefix", F.col("rest").alias("u")).join(titles, "u", "left_semi").groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= RECURRING).select("prefix", F.lit(True).alias("points"))
    headed = headed.join(broadcast_if_small(pointing), "prefix", "left").join(titles.select(F.col("u").alias("rest"), F.lit(True).alias("pointed")), "rest", "left")
    # A heading opens a list of links, a sentence outside the template closes it.
    links = F.coalesce(F.last(F.when(F.col("heading"), True).when(F.col("sent") & ~F.col("t"), False), ignorenulls=True).over(page), F.lit(False))
    placed = headed.withColumn("links", links)
    found = F.col("heading") | (F.col("t") & ~F.col("title")) | (F.col("open") & (F.col("links") | (F.coalesce("points", F.lit(False)) & F.coalesce("pointed", F.lit(False)))))
    return placed.where(found).select("page_id", "line_no")


def _own(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "document_path", "text").where("text IS NOT NULL AND page_id IS NOT NULL").dropDuplicates(["page_id"])


def furniture_told(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, told_by) of every non-blank line that is not body; ``told_by`` is template or list."""
    own = checkpoint(_own(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for page, text in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                told = listed_lines(text.split("\n"))
                ids.extend([page] * len(told))
                found.extend(told)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int32())], names=["page_id", "line_no"])

    listed = own.select("page_id", "text").mapInArrow(run, "page_id long, line_no int").withColumn("told_by", F.lit("list"))
    return listed.unionByName(template_lines(own).withColumn("told_by", F.lit("template"))).groupBy("page_id", "line_no").agg(F.max("told_by").alias("told_by"))


def furniture(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of every non-blank line that is not body."""
    return furniture_told(pages).select("page_id", "line_no")


def main_body(pages: DataFrame) -> DataFrame:
    """(page_id, body): each page's body lines; an empty body where nothing is left."""
    gone = furniture(pages).groupBy("page_id").agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split("text", "\n"), lambda x, k: (F.regexp_replace(x, f"[{WHITE}]+", "") != "") & ~F.coalesce(F.array_contains("_gone", k + 1), F.lit(False)))
    return pages.select("page_id", "text").where("page_id IS NOT NULL").dropDuplicates(["page_id"]).join(gone.hint("merge"), "page_id", "left").select("page_id", F.array_join(kept, "\n").alias("body"))
