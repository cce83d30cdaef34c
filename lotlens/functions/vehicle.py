"""What an ad's words say about a vehicle: make, gearbox, fuel, body, colour, seller, damage, and whether it is one at all.

All are cascades of column expressions over plain text (small letters, no marks, single spaces). Patterns use no look-around,
so that any engine's regular expressions read them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain

# Spellings, words and codes that results must agree on.
BRAND_ALIAS = {
    "vw": "volkswagen", "volks": "volkswagen", "chevy": "chevrolet", "merc": "mercedes-benz", "mercedes": "mercedes-benz", "mercedes benz": "mercedes-benz", "mb": "mercedes-benz",
    "peugeut": "peugeot", "land-rover": "land rover", "alfa": "alfa romeo", "great wall": "gwm", "ds automobiles": "ds", "jac motors": "jac",
}
MANUAL = r"\b(manual|caja mecanica|\d?\s?mt|m/t)\b"
AUTOMATIC = r"\b(automatic[oa]?|autom|aut|\d?\s?at|a/t|e?cvt|tiptronic|steptronic|multitronic|powershift|s-?tronic|dsg|dct|edct|secuencial|xtronic|easytronic|dualogic)\b"
FUELS = {
    "electrico": r"\b(electrico|100% electrico|ev)\b", "hibrido": r"\b(hibrido|hybrid|hev|phev|mhev)\b", "gnc": r"\b(gnc|gas natural)\b",
    "diesel": r"\b(diesel|gasoil|tdi|hdi|tdci|crdi|dci|jtd|multijet|turbo ?diesel)\b", "nafta": r"\b(nafta|naftero|gasolina|flex)\b",
}
SELLERS = {
    "particular": "private", "dueno directo": "private", "privado": "private", "private": "private", "concesionaria": "dealer", "concesionario": "dealer", "agencia": "dealer",
    "dealer": "dealer", "tienda oficial": "dealer", "profesional": "dealer",
}
SELLER_STOPLIST = (
    "particular", "dueno", "dueno directo", "vendedor", "concesionaria", "agencia", "whatsapp", "instagram", "facebook", "ver perfil", "contacto", "consultar", "informacion del vendedor",
)
BODY_CODES = ("sedan", "hatchback", "suv", "pickup", "rural", "monovolumen", "coupe", "convertible", "utilitario")
BODY_WORDS = {
    "convertible": r"\b(cabrio|cabriolet|convertible|descapotable|roadster|spider|spyder)\b", "suv coupe": r"\b(suv coupe|coupe suv)\b", "coupe": r"\b(coupe|cupe|koup)\b",
    "pickup": r"\b(pick ?-?up|doble cabina|cabina doble|cabina simple|cabina extendida|d/c|c/d|c/s|oroch)\b", "utilitario": r"\b(furgon|furgoneta|utilitario|mini ?bus|combi|kombi)\b",
    "monovolumen": r"\b(mono ?volumen|minivan|mpv|picasso|multispace|patagonica)\b", "rural": r"\b(rural|wagon|sw|weekend|variant|sportwagen|cw)\b", "suv": r"\b(suv|crossover|todo ?terreno)\b",
    "sedan": r"\b(sedan)\b", "hatchback": r"\b(hatchback|hatch|sportback|hb)\b",
}
BODY_SOURCE = {
    "hatch": "hatchback", "crossover": "suv", "off road": "suv", "offroad": "suv", "todoterreno": "suv", "todo terreno": "suv", "pick up": "pickup", "minivan": "monovolumen", "mono volumen": "monovolumen",
    "cabriolet": "convertible", "cabrio": "convertible", "roadster": "convertible", "furgon": "utilitario", "furgoneta": "utilitario", "van": "utilitario", "wagon": "rural", "station wagon": "rural",
}
COLOR_WORDS = {
    "blanco": "blanco blanca blancos blancas white branco bianco marfil perla perlado nieve", "negro": "negro negra negros negras black noir nero preto vulcano",
    "gris": "gris grises grey gray plata plateado plateada silver prata cinza grafito plomo titanio acero aluminio platino", "azul": "azul azules azulado celeste blue petroleo turquesa marino",
    "rojo": "rojo roja rojos red rosso vermelho bordo bordeaux burdeos granate vino", "verde": "verde verdes green oliva",
    "beige": "beige bege marron brown cafe champagne dorado dorada oro bronce cobre ocre arena crema habano chocolate tostado", "otro": "amarillo amarilla naranja violeta rosa rosado lila fucsia purpura yellow orange bicolor",
}
COLOR_ELSEWHERE = "interior interiores tapizado tapizados tapiceria cuero tela butaca butacas asiento asientos alfombra volante techo llanta llantas rueda ruedas espejo espejos manija paragolpe paragolpes capota camara pantalla radio luz luces tablero consola".split()
#: What a title says where its price is no total, without accents; the first that is found is the reason.
PARTIAL_WORDS = (
    r"\banticipo\b",
    r"\banticip\w*",
    r"\bcuotas?\b",
    r"\b\d+\s*cuota",
    r"\b\d+\s*x\s*\$",
    r"/mes\b",
    r"\bx\s*mes\b",
    r"\bplan\s+(adjudicad|oficial|rombo|ovalo|fiat|peugeot|chevrolet|vw|ford|gm|nacional|de\s+ahorro)",
    r"\bplan\s+\w+",
    r"\badjudicad",
    r"\bcirculo\s+cerrado",
    r"\bsuscripcion\b",
    r"\bsuscribirse\b",
    r"\bahorro\s+previo",
    r"\bsolo\s+permuta\b",
    r"\bpermuto\s+por\b",
    r"\bsenia\b",
    r"\bsena\b",
    r"\bentrega\s+inmediata\s+\$\s*\d",
    r"\bentrega\s+y\s+cuotas",
    r"\bsin\s+entrega",
    r"\bfinanci\w+\s+(100|total)",
    r"\bplanes?\s+de\s+ahorro",
    r"\bcredito\s+\w*\s*aprobado",
)
PARTIAL = "|".join(PARTIAL_WORDS)
BLANK_TOTAL = r"\bpor\s*\.\s*solo\s*(u\$[sd]|us\$|\$)"
DAMAGE = r"(chocad[oa]s?|siniestrad[oa]s?|granizad[oa]s?|volcad[oa]s?|incendiad[oa]s?|con choque|para reparar|para arreglar)"
NEGATION = r"(no|sin|nunca|jamas|cero)"
AGENCY_STRONG = r"(financiamos|(tomamos|recibimos|aceptamos) (tus? |sus? )?(usados?|autos?|vehiculos?|unidad(es)?)|te lo compramos|compramos tus? (autos?|usados?|vehiculos?)|somos (una )?(agencias?|concesionari[ao]s?)|nuestr[oa]s? (agencias?|concesionari[ao]s?|local(es)?|salon(es)?|showrooms?))"
AGENCY_WEAK = (
    r"\bsolo (con )?(el |tu )?dni\b", r"\bcuotas (fijas|en pesos)\b",
    r"\b(credito prendario|financiacion (propia|accesible|en pesos|bancaria|personalizada|disponible)|(opciones|planes) de financiacion)\b", r"\bconsignacion(es)?\b", r"\bhorario de atencion\b",
)
PART = r"^((vendo|venta|se vende|oferta|kit|juego|par|set|original|nuevo|nueva|usado|repuesto|tengo)( de)? ){0,3}(par[aq]golpes?|butacas?|asientos?|cremalleras?|faros?|opticas?|embragues?|espejos?|puertas?|porton|capot|tableros?|radiador\w*|alternador\w*|amortiguador\w*|bomba de|tapa de|motor de arranque|parabrisas|lunetas?|volantes?|guardabarros?|autopartes?|repuestos?|desarmes?|cubre\w*|manijas?|alfombras?|fundas?|sensor\w*|bujias?|correas?|pastillas?)\b"
PART_ANYWHERE = r"\b(desarmes?|autopartes?|repuestos (de|para))\b"
NOT_PART = r"\bno (es )?((un|para|de) )?(desarmes?|autopartes?|repuestos?)\b"
WANTED = r"^((19[89]\d|20[0-3]\d)\s+)?(busco|compro|buscamos|compramos)\b"
OFFERS = r"\b(vend\w*|permut\w*|cambio|canje)\b"
TOY = r"\bescala\s*:?\s*1\s*[:/.\s-]\s*\d{1,3}\b|\ba escala\b|\b(autos?|autitos?|coches?|camionetas?) a control remoto\b|\bfasciculos?\b|\bdie ?cast\b|\bhot ?wheels?\b"
CAR_WORDS = r"\bvendo mi\b|\bpermut\w*|\btitular\b|\bpapeles al dia\b|\bvtv\b|\bformulario 08\b|\b08 firmado\b|\bunico dueno\b|\bkm reales\b|\bdueno directo\b"
YEAR_FIRST = r"^(19[89]\d|20[0-3]\d)\s+\S"
KM_IN_TITLE = r"\b[1-9][\d.,]*\s*(mil\s*)?(km|kms|kilometros)\b"
HIGH_END = ("porsche", "ferrari", "lamborghini", "maserati", "bentley", "bmw", "mercedes-benz", "audi", "land rover", "lexus", "volvo", "jaguar", "alfa romeo", "cadillac", "lincoln")
USD_CEILING, ARS_FROM = 100_000, 1_000_000
USD_BOUNDS, ARS_LEAST = (1_000, 1_000_000), 500_000


def chosen(t: Column, kinds: dict[str, str]) -> Column:
    """The first kind whose pattern is in the text."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in kinds.items():
        out = out.when(t.rlike(pattern), name)
    return out


def brand(c: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in BRAND_ALIAS.items() for x in pair])
    return F.coalesce(F.element_at(aliases, plain(c)), plain(c))


def base_model(c: Column) -> Column:
    """The first two words of a model's name."""
    return F.array_join(F.slice(F.split(plain(c), " "), 1, 2), " ")


def transmission(*texts: Column) -> Column:
    """From the first text that names one kind and not the other."""
    each = [F.when(plain(t).rlike(MANUAL) != plain(t).rlike(AUTOMATIC), F.when(plain(t).rlike(MANUAL), "manual").otherwise("automatic")) for t in texts]
    return F.coalesce(*each)


def fuel(*texts: Column) -> Column:
    return F.coalesce(*[chosen(plain(t), FUELS) for t in texts])


def seller_type(c: Column) -> Column:
    """The whole label, else the first known word in it."""
    t = plain(c)
    exact = F.element_at(F.create_map(*[F.lit(x) for pair in SELLERS.items() for x in pair]), t)
    out = F.when(F.lit(False), F.lit(""))
    for word, kind in SELLERS.items():
        out = out.when(t.rlike(rf"\b{word}\b"), kind)
    return F.coalesce(exact, out)


def doors(c: Column) -> Column:
    return F.nullif(F.regexp_extract(plain(c), r"\b([345]) ?(p|ptas?|pts|puertas)\b", 1), F.lit("")).cast("int")


def body_words(c: Column) -> Column:
    """A body word; a sedan of three or five doors is no sedan."""
    t = plain(c)
    hit = chosen(t, BODY_WORDS)
    later = F.when(t.rlike(BODY_WORDS["hatchback"]), "hatchback")
    return F.when(hit == "suv coupe", "suv").when((hit == "sedan") & F.coalesce(doors(c).isin(3, 5), F.lit(False)), later).otherwise(hit)


def body_type(trim: Column, title: Column, source: Column, allowed: Column) -> tuple[Column, Column]:
    """(code, method): words in the version or title, the source's value if the model has it, doors, a model's only body."""
    words = F.coalesce(body_words(trim), body_words(title))
    key = F.trim(F.regexp_replace(plain(source), r"[\s_/-]+", " "))
    codes = F.create_map(*[F.lit(x) for pair in ({c: c for c in BODY_CODES} | BODY_SOURCE).items() for x in pair])
    stated = F.element_at(codes, key)
    known = F.coalesce(F.size(allowed), F.lit(0))
    fits = stated.isNotNull() & ((known <= 0) | F.coalesce(F.array_contains(allowed, stated), F.lit(False)))
    n = F.coalesce(doors(trim), doors(title))
    by_doors = F.when(n.isin(3, 5), "hatchback").when(n == 4, "sedan")
    doors_fit = (known > 1) & F.coalesce(F.array_contains(allowed, by_doors), F.lit(False))
    code = F.when(words.isNotNull(), words).when(fits, stated).when(doors_fit, by_doors).when(known == 1, F.get(allowed, F.lit(0)))
    method = F.when(words.isNotNull(), "keyword").when(fits, "source").when(doors_fit, "doors").when(known == 1, "catalog").otherwise("none")
    return code, method


def _color_of(word: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for code, words in COLOR_WORDS.items():
        out = out.when(word.isin(*words.split()), code)
    return out


def color_stated(c: Column) -> Column:
    """A source's colour: the first known word of its value."""
    words = F.split(F.trim(F.regexp_replace(plain(c), r"[^a-z]+", " ")), " ")
    return F.get(F.filter(F.transform(words, _color_of), lambda x: x.isNotNull()), F.lit(0))


def color_written(c: Column) -> Column:
    """A colour in a text, only after "color" or "pintura", unless the word before is another part's; two that differ say nothing."""
    words = F.split(F.trim(F.regexp_replace(plain(c), r"[^a-z]+", " ")), " ")
    places = F.sequence(F.lit(1), F.size(words))
    at = lambda i, k: F.coalesce(F.get(words, i - 1 + k), F.lit(""))
    anchored = F.filter(places, lambda i: at(i, 0).isin("color", "pintura") & ~at(i, -1).isin(*COLOR_ELSEWHERE) & ~at(i, -2).isin(*COLOR_ELSEWHERE) & ~at(i, -3).isin(*COLOR_ELSEWHERE))
    skip = lambda i: F.when(at(i, 1) == "exterior", F.when(at(i, 2).isin("es", "en"), 3).otherwise(2)).when(at(i, 1).isin("es", "en"), 2).otherwise(1)
    found = F.array_distinct(F.filter(F.transform(anchored, lambda i: _color_of(F.coalesce(F.get(words, i - 1 + skip(i)), F.lit("")))), lambda x: x.isNotNull()))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def partial_reason(title: Column, description: Column) -> Column:
    """Why the published number can't be the total: the title's words, or a total left blank."""
    hit = F.nullif(F.regexp_extract(plain(title), f"({PARTIAL})", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("keyword: "), F.trim(hit)), F.when(plain(description).rlike(BLANK_TOTAL), "keyword: precio total en blanco"))


def damaged(title: Column) -> Column:
    """The title says the car is damaged, at one place at least without a negation up to two words before."""
    bare = F.regexp_replace(plain(title), rf"\b{NEGATION}\s+(\w+\s+)?{DAMAGE}\b", " ")
    return bare.rlike(rf"\b{DAMAGE}\b")


def agency_voice(c: Column) -> Column:
    """A dealer's way of writing: one strong phrase that isn't negated, or two weak ones."""
    t = plain(c)
    strong = F.regexp_replace(t, rf"\bno {AGENCY_STRONG}\b", " ").rlike(rf"\b{AGENCY_STRONG}\b")
    weak = sum((t.rlike(p).cast("int") for p in AGENCY_WEAK), F.lit(0))
    return F.coalesce(strong | (weak >= 2), F.lit(False))


def not_vehicle(title: Column, description: Column, year: Column, km: Column) -> Column:
    """part, wanted or toy; null if it may be a car. Evidence of a whole car outweighs a part's or a toy's words."""
    t = F.trim(F.regexp_replace(F.regexp_replace(plain(title), r"[^\w\s,./:-]", " "), r"\s+", " "))
    both = F.concat_ws(" ", t, plain(description))
    known = year.isNotNull() & km.isNotNull()
    part = F.trim(F.regexp_replace(t, NOT_PART, " "))
    car = known | t.rlike(YEAR_FIRST) | t.rlike(KM_IN_TITLE) | both.rlike(CAR_WORDS)
    kind = F.when(part.rlike(PART) | part.rlike(PART_ANYWHERE), "part").when(t.rlike(TOY), "toy")
    return F.when(t.rlike(WANTED) & ~t.rlike(OFFERS) & ~known, "wanted").when(~car, kind)


def price_currency(amount: Column, currency: Column, sign: Column, make: Column) -> Column:
    """Dollars read from a bare sign, at or over the ceiling, of no costly make: pesos from a million, unreadable below it."""
    explicit = F.coalesce(F.lower(F.trim(sign)).rlike(r"^(us\$|u\$s|usd|u\$d)$"), F.lit(False))
    costly = F.coalesce(brand(make).isin(*HIGH_END), F.lit(False))
    doubtful = (currency == "USD") & (amount >= USD_CEILING) & ~explicit & ~costly
    return F.when(F.coalesce(doubtful, F.lit(False)), F.when(amount >= ARS_FROM, "ARS")).otherwise(currency)


def plausible(amount: Column, currency: Column) -> Column:
    """Whether a vehicle can cost that: each currency has its own bounds."""
    return F.coalesce(F.when(currency == "USD", amount.between(*USD_BOUNDS)).when(currency == "ARS", amount >= ARS_LEAST), F.lit(False))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def seller_key(name: Column) -> Column:
    """One key for a seller's spellings: symbols out, initials joined, a phone as its national number, labels of no one as null."""
    bare = F.regexp_replace(F.regexp_replace(plain(name), r"[.'’`´]", ""), r"[^a-z0-9 ]+", " ")
    single = lambda w: w.rlike("^[a-z]$")

    def join(t: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(False).alias("one"))
        step = lambda a, w: F.struct(F.when(a["out"] == "", w).when(a["one"] & single(w), F.concat(a["out"], w)).otherwise(F.concat(a["out"], F.lit(" "), w)).alias("out"), single(w).alias("one"))
        return F.aggregate(F.split(t, " "), start, step, lambda a: a["out"])

    def key(t: Column) -> Column:
        digits = F.replace(t, F.lit(" "), F.lit(""))
        name = let(join(t), lambda j: F.when((F.length(j) >= 3) & ~j.isin(*SELLER_STOPLIST), j))
        return F.when(t == "", F.lit(None).cast("string")).when(digits.rlike("^[0-9]+$"), phone_key(digits)).otherwise(name)

    return let(F.trim(F.regexp_replace(bare, r"\s+", " ")), key)


def phone_key(digits: Column) -> Column:
    """tel: and the national number of ten digits: no country code, mobile mark, trunk zero or local 15."""

    def at_home(d: Column) -> Column:
        mobile = lambda x: F.when(x.startswith("9") & (F.length(x) > 10), F.substring(x, 2, 100)).otherwise(x)
        return F.when(d.startswith("54") & (F.length(d) > 10), let(F.substring(d, 3, 100), mobile)).otherwise(d)

    def local(d: Column) -> Column:
        out = d
        for at in (4, 3, 2):
            out = F.when((F.length(d) == 12) & (F.substring(d, at + 1, 2) == "15"), F.concat(F.substring(d, 1, at), F.substring(d, at + 3, 100))).otherwise(out)
        return out

    home = let(F.regexp_replace(digits, "^00", ""), at_home)
    area = let(home, lambda d: F.when(d.startswith("0"), F.substring(d, 2, 100)).otherwise(d))
    return let(let(area, local), lambda d: F.when(F.length(d) >= 8, F.concat(F.lit("tel:"), F.right(d, F.lit(10)))))
