"""Fixed values of the candidate policy: words, patterns and URL parts, compared on folded text."""

POSITIVE = (
    "concurso", "concurso publico", "convocatoria", "vacante", "vacantes", "llamado", "cargo", "puesto", "postulacion", "postular", "recepcion de antecedentes", "trabaja con nosotros",
    "trabaje con nosotros", "empleo", "oportunidad laboral", "oferta laboral", "ofertas laborales", "requisitos", "funciones", "renta bruta mensual", "remuneracion mensual", "honorarios mensuales", "contrata", "planta",
    "codigo del trabajo", "calidad juridica", "reemplazo", "suplencia", "fecha de cierre", "cierre de postulacion", "postulaciones hasta", "se requiere contratar", "bases", "perfil de cargo", "tdr", "terminos de referencia",
    "alta direccion publica", "adp",
)
NEGATIVE = (
    r"\bresultados? del concurso\b", r"\bresultados? proceso\b", r"\bn[oó]mina de seleccionad[oa]s\b", r"\bn[oó]mina final\b", r"\blista de seleccionad[oa]s\b", r"\badjudicaci[oó]n\b", r"\bproceso adjudicado\b",
    r"\bproceso finalizado\b", r"\bproceso cerrado\b", r"\bconcurso cerrado\b", r"\bconvocatoria cerrada\b", r"\bpostulaciones cerradas\b", r"\bnoticias?\b", r"\bcomunicado\b", r"\bbolet[ií]n\b", r"\bnovedades?\b", r"\bprensa\b",
    r"\bdeclaraci[oó]n p[uú]blica\b", r"\bagenda institucional\b", r"\bcuenta p[uú]blica\b", r"\bevento\b", r"\bseminario\b", r"\bcharla\b", r"\bworkshop\b", r"\blicitaci[oó]n\b", r"\bcompra p[uú]blica\b",
    r"\bmercado p[uú]blico\b", r"\bsubvenci[oó]n\b", r"\bfondos? concursables?\b", r"\bconcurso art[ií]stico\b", r"\bconcurso escolar\b", r"\bconcurso de proyectos?\b", r"\bconcurso (?:de )?cuentos?\b",
    r"\bconcurso (?:de )?fotograf[ií]as?\b", r"\bproceso del a[nñ]o (?:201\d|20[12]0)\b", r"\bconcursos? anteriores?\b", r"\barchivo hist[oó]rico\b", r"\bhist[oó]rico de concursos?\b", r"\bpublicaci[oó]n institucional\b",
    r"\bart[ií]culo\b", r"\bblog\b", r"\bmemoria anual\b", r"\bsala\s*de\s*prensa\b", r"\bgaler[ií]a de fotos?\b", r"\bconvocatoria de becas?\b", r"\bllamado a becas?\b", r"\bbeneficios?\s+sociales?\b",
)
NEGATIVE_URL = (
    "/noticias", "/news", "/prensa", "/sala-de-prensa", "/sala_de_prensa", "/saladeprensa", "/blog", "/comunicados", "/actas", "/cuenta-publica", "/cuenta_publica", "/cuentapublica", "/agenda", "/eventos", "/galeria",
    "/galería", "/multimedia", "/historico", "/histórico", "/anteriores", "/resultados-concurso", "/nomina-", "/adjudicacion", "/licitacion", "/licitaciones", "/compras", "/mercadopublico", "/subvenciones",
    "/fondos-concursables",
)
INTERNAL = (r"\bsolo difusi[oó]n\b", r"\bsolo difusi[oó]n interna\b", r"\bdifusi[oó]n interna\b")
