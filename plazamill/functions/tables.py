"""Fixed values of rules: words, patterns, labels and lookup tables, each complete and in its order."""

#: Words of which a posting holds one in title or body.
JOB_WORDS = (
    "concurso publico", "llamado a concurso", "provision de cargo", "proveer cargo", "vacante", "planta municipal", "cargo de planta", "cargo a contrata", "cargo contrata", "honorarios",
    "seleccion de personal", "proceso de seleccion", "reclutamiento", "postulacion", "postulantes", "trabaje con nosotros", "trabaja con nosotros", "oferta laboral", "oferta de empleo",
    "llamado a postulacion", "bases concurso", "bases del concurso", "reemplazo", "suplencia", "banco de reemplazos", "banco curricular", "estatuto administrativo", "ley 18.883", "ley 18883",
    "ley 19.378", "ley 19378", "escalafon", "grado eus", "grado ems", "escala municipal", "curriculum", "cv", "antecedentes", "postular", "perfil del cargo", "descriptor de cargo",
    "requisitos del cargo",
)
#: Words that reject a title.
REJECT_WORDS = (
    "concurso de fotografia", "concurso literario", "concurso artistico", "concurso cultural", "concurso de dibujo", "concurso de pintura", "concurso de cuento", "concurso de poesia",
    "concurso musical", "concurso de canto", "concurso de video", "concurso fondeve", "fondo concursable", "concurso vecinal", "concurso comunitario", "concurso estudiantil",
    "concurso escolar", "concurso juvenil", "reina", "embajadora", "carnaval", "festival", "licitacion", "propuesta publica", "llamado a propuesta", "bases de licitacion",
    "contratacion de servicios", "adquisicion", "cotizacion", "presupuesto participativo", "inauguracion", "ceremonia", "capacitacion vecinal", "cuenta publica", "rendicion", "memoria anual",
    "plan regulador", "ordenanza", "subsidio", "beneficio social", "postulacion vivienda", "beca", "fondo solidario", "fonasa", "permiso de circulacion", "patente comercial",
    "permiso de edificacion",
)
#: Words that reject a title before all others.
HARD_REJECT_WORDS = (
    "licitacion", "fondeve", "beca", "subsidio", "permiso de circulacion", "patente comercial", "festival",
)
#: Words that accept a blog post by its title.
WP_TITLE_JOB = (
    "concurso publico", "llamado a concurso", "proceso de seleccion", "cargo", "vacante", "honorario", "contrata", "planta", "postulacion", "seleccion de personal", "reclutamiento",
    "profesional", "tecnico", "auxiliar", "administrativo", "asistente", "inspector", "conductor", "chofer", "enfermero", "enfermera", "medico", "medica", "abogado", "abogada", "director",
    "directora", "jefe", "jefa", "coordinador", "coordinadora", "encargado", "encargada",
)
#: Words that reject a blog post by its title.
WP_TITLE_REJECT = (
    "resultado", "ganador", "ganadora", "adjudicacion", "licitacion", "acta", "resolucion exenta", "decreto", "acuerdo", "nomina", "lista de", "informe", "rendicion", "invitacion a", "taller",
    "capacitacion", "seminario", "webinar",
)
#: Link texts worth 5.
LINK_STRONG_TEXT = (
    "concurso publico", "concursos publicos", "concursos públicos", "concurso público", "trabaja con nosotros", "bolsa de empleo", "bolsa nacional de empleo", "bolsa de trabajo",
    "ofertas laborales", "ofertas de empleo", "ofertas de trabajo", "recursos humanos", "departamento de personal", "convocatorias publicas", "postulaciones abiertas",
)
#: Link targets worth 4.
LINK_STRONG_HREF = (
    "concursos-publicos", "concurso-publico", "concursos_publicos", "concursos-municipales", "trabaja-con-nosotros", "trabajaconnosotros", "recursos-humanos", "recursos_humanos", "rrhh",
    "ofertas-laborales", "ofertas-empleo", "bolsa-empleo", "bolsa-de-empleo", "empleos-publicos", "concurso_publicos", "/empleos/", "/empleo/", "/concursos/", "/concurso/", "/omil/", "omil-",
)
#: Link texts worth 3.
LINK_WEAK_TEXT = (
    "concursos", "concurso", "empleos", "empleo", "trabajo", "omil", "postulaciones", "convocatoria", "vacantes",
)
#: Link targets worth 2.
LINK_WEAK_HREF = (
    "concurs", "empleo", "trabaja", "omil", "postul", "convocatoria", "vacant", "carrera", "rrhh", "recursos",
)
#: Words near an amount that speak for pay.
PAY_GOOD = (
    "renta bruta mensual", "renta bruta", "renta líquida", "renta liquida", "remuneración mensual", "remuneracion mensual", "sueldo base", "honorarios mensuales", "monto mensual",
    "total haberes", "renta ofrecida", "renta", "sueldo", "remuneración", "honorarios",
)
#: Words near an amount that speak against pay.
PAY_BAD = (
    "presupuesto", "monto total", "convenio", "programa", "financiamiento", "total proyecto", "resolución", "resolucion", "decreto", "licitación", "licitacion", "inversión", "inversion",
    "recursos", "anual", "semestral", "global",
)
#: Mail domains for one use.
DISPOSABLE = (
    "mailinator.com", "guerrillamail.com", "guerrillamail.net", "guerrillamail.org", "tempmail.com", "throwaway.email", "10minutemail.com", "yopmail.com", "yopmail.fr", "yopmail.net",
    "trashmail.com", "trashmail.net", "sharklasers.com", "guerrillamailblock.com", "grr.la", "dispostable.com", "temp-mail.org", "tempail.com", "emailondeck.com", "mintemail.com",
    "maildrop.cc", "getairmail.com", "mohmal.com", "fakeinbox.com", "mailnesia.com", "discard.email", "discardmail.com", "mailcatch.com", "meltmail.com", "mytemp.email", "tempr.email",
    "tmpmail.net", "tmpmail.org", "wegwerfmail.de", "trash-mail.com", "mailsac.com", "harakirimail.com", "spamgourmet.com", "spamfree24.org", "binkmail.com", "safetymail.info", "nospam.ze.tc",
    "mailforspam.com", "inboxalias.com", "jetable.org",
)
#: Mail domains and how they are misspelt.
MISSPELT = {
    "gmail.com": ("gmial.com", "gmal.com", "gmaill.com", "gamil.com", "gnail.com", "gimail.com", "gmil.com", "gail.com", "gmali.com", "gemail.com", "gmail.co", "gmail.cl", "gmsil.com", "gmeil.com"),
    "hotmail.com": ("hotnail.com", "hotmal.com", "hotmaill.com", "hotmial.com", "hotmil.com", "hotamil.com", "hotmai.com", "hotmsil.com", "hitmail.com", "hotimail.com", "hotmail.co"),
    "outlook.com": ("outloo.com", "outlok.com", "outloock.com", "outlool.com", "outllok.com", "outlook.co"),
    "yahoo.com": ("yaho.com", "yahooo.com", "yhaoo.com", "yhoo.com", "yahoo.co", "yaoo.com"),
    "outlook.cl": ("outloo.cl", "outlok.cl", "outloock.cl"),
    "hotmail.cl": ("hotnail.cl", "hotmal.cl", "hotmaill.cl"),
    "gmail.cl": (),
    "live.com": ("live.co", "lve.com", "ive.com"),
    "icloud.com": ("iclud.com", "icloud.co", "icolud.com"),
}
#: Terms of job pages.
JOB_CLUSTER = (
    "concurso publico", "convocatoria", "postulacion", "bases", "perfil del cargo", "requisitos", "funciones", "honorarios", "contrata", "planta", "remuneracion", "vacante",
    "recepcion de antecedentes",
)
#: Terms of other pages.
OTHER_CLUSTER = (
    "subsidio", "beca", "fondo concursable", "noticia", "actividad", "taller", "operativo", "beneficio", "tramite", "cuenta publica", "licitacion", "programa", "curso", "feria",
)
#: Titles of mere listings.
LISTING_TITLES = (
    "concursos", "concursos abiertos", "concursos abiertos y cerrados", "concursos cerrados", "licitaciones", "tramites", "trabaja con nosotros", "ofertas laborales",
)
#: Weights of the signals of a page.
SIGNAL_WEIGHTS = {
    "jobposting_jsonld": 0.35,
    "future_deadline": 0.3,
    "closing_metadata": 0.25,
    "pdf_bases_or_profile": 0.2,
    "known_ats": 0.25,
    "job_cluster": 0.15,
    "listing_only_title": -0.3,
    "negative_cluster": -0.35,
    "old_without_open_signal": -0.3,
    "generic_landing_page": -0.25,
    "bot_waf_js": -0.2,
}
#: Texts of an open call.
OPEN_SIGNALS = (
    "convocatoria vigente", "proceso abierto", "postulacion abierta", "recepcion de antecedentes", "en curso", "se extiende el plazo",
)
#: Texts of a closed call.
EXPIRED_SIGNALS = (
    "proceso cerrado", "convocatoria finalizada", "postulaciones cerradas", "plazo vencido", "resultado final", "nomina de seleccionados", "acta de seleccion",
)
#: Titles of landing pages.
LANDING_TITLES = (
    "concursos", "concursos abiertos", "concursos cerrados", "concursos abiertos/cerrados", "licitaciones", "tramites", "feria",
)
#: Texts of other matters.
NOT_JOB_MARKERS = (
    "subsidio", "beca", "fondo concursable", "noticia", "actividad", "taller", "operativo", "beneficio", "tramite", "cuenta publica", "licitacion", "feria", "jefas de hogar",
)
#: Labels before a publication date.
PUBLICATION_LABELS = (
    "fecha de publicacion", "publicado el", "publicacion", "posted on",
)
#: Labels before a deadline.
DEADLINE_LABELS = (
    "fecha limite de postulacion", "recepcion de antecedentes hasta", "postulaciones hasta", "plazo de postulacion", "cierre de postulacion", "se recibiran antecedentes hasta",
    "se recibiran los antecedentes hasta", "hasta el", "recepcion hasta",
)
#: Labels before a closing date.
CLOSING_LABELS = (
    "fecha de cierre", "fecha cierre", "cierre", "fecha_cierre",
)
#: Texts of a bot barrier.
BOT_MARKERS = (
    "cloudflare", "captcha", "access denied", "bot detection", "waf",
)
#: Texts of a page that needs scripts.
JS_MARKERS = (
    "enable javascript", "requires javascript", "__next", "window.__", "hydration",
)
#: Texts of a WordPress page.
WORDPRESS_MARKERS = (
    "wp-content", "wp-json", "wordpress", "wp-includes",
)
#: Parts of news URLs.
NEWS_PATHS = (
    "/noticias", "/news", "/prensa", "/blog", "/comunicados",
)
#: Parts of the URLs of job portals.
ATS_HOSTS = (
    "trabajando.cl", "hiringroom", "buk.cl",
)
#: Words near a mail address for applications.
APPLY_HINTS = (
    "enviar antecedentes", "remitir postulación", "remitir postulacion", "recepción de antecedentes", "recepcion de antecedentes", "postular a", "postulaciones se recibirán en",
    "postulaciones se recibiran en", "hacer llegar cv", "enviar documentos a", "postular al correo",
)
#: Words near a mail address for questions.
ASK_HINTS = (
    "consultas a", "consultas del proceso a", "para consultas", "dudas al correo", "informaciones en", "consultas sobre el proceso a", "contacto", "escribir a", "comunicarse con",
    "correo de contacto", "mesa de ayuda",
)
#: Region aliases (folded, upper case, no stops) and display names.
REGION_ALIASES = {
    "RM": "Región Metropolitana",
    "METROPOLITANA": "Región Metropolitana",
    "METROPOLITANA DE SANTIAGO": "Región Metropolitana",
    "MAULE": "Región del Maule",
    "BIOBIO": "Región del Biobío",
    "BIOBÍO": "Región del Biobío",
    "NUBLE": "Región de Ñuble",
    "ÑUBLE": "Región de Ñuble",
    "OHIGGINS": "Región del Libertador General Bernardo O'Higgins",
    "O'HIGGINS": "Región del Libertador General Bernardo O'Higgins",
    "OHÍGGINS": "Región del Libertador General Bernardo O'Higgins",
    "ARICA Y PARINACOTA": "Región de Arica y Parinacota",
    "ATACAMA": "Región de Atacama",
    "AYSEN": "Región de Aysén del General Carlos Ibáñez del Campo",
    "AYSÉN": "Región de Aysén del General Carlos Ibáñez del Campo",
    "ANTOFAGASTA": "Región de Antofagasta",
    "COQUIMBO": "Región de Coquimbo",
    "LA ARAUCANIA": "Región de La Araucanía",
    "LA ARAUCANÍA": "Región de La Araucanía",
    "LOS RIOS": "Región de Los Ríos",
    "LOS RÍOS": "Región de Los Ríos",
    "LOS LAGOS": "Región de Los Lagos",
    "TARAPACA": "Región de Tarapacá",
    "TARAPACÁ": "Región de Tarapacá",
    "VALPARAISO": "Región de Valparaíso",
    "VALPARAÍSO": "Región de Valparaíso",
    "MAGALLANES": "Región de Magallanes y de la Antártica Chilena",
}
#: Institution or abbreviation, law, title, number of the norm; the first that fits decides.
LAWS = (
    ("Servicio Civil", "Ley 19.882", "Ley de Nuevo Trato Laboral y Alta Dirección Pública", "211480"),
    ("Contraloría General de la República", "Ley 10.336", "Ley de Organización y Atribuciones de la Contraloría General de la República", "25808"),
    ("Poder Judicial", "DFL 1 (Justicia)", "Código Orgánico de Tribunales", "25563"),
    ("Ministerio Público", "Ley 19.640", "Ley Orgánica Constitucional del Ministerio Público", "145437"),
    ("Banco Central de Chile", "Ley 18.840", "Ley Orgánica Constitucional del Banco Central de Chile", "30105"),
    ("Dirección del Trabajo", "DFL 2 (Trabajo)", "Ley Orgánica de la Dirección del Trabajo", "5765"),
    ("Servicio de Impuestos Internos", "DFL 7 (Hacienda)", "Ley Orgánica del Servicio de Impuestos Internos", "5618"),
    ("Carabineros de Chile", "Ley 18.961", "Ley Orgánica Constitucional de Carabineros de Chile", "30329"),
    ("Policía de Investigaciones", "DL 2.460", "Ley Orgánica de la Policía de Investigaciones de Chile", "6956"),
    ("Registro Civil", "DFL 1 (Justicia, 2000)", "Ley Orgánica del Servicio de Registro Civil e Identificación", "176076"),
    ("Gendarmería de Chile", "DL 2.859", "Ley Orgánica de Gendarmería de Chile", "7024"),
    ("Servicio Nacional de Aduanas", "DFL 329 (Hacienda)", "Ley Orgánica del Servicio Nacional de Aduanas", "5328"),
    ("Tesorería General de la República", "DFL 1 (Hacienda, 1994)", "Estatuto Orgánico del Servicio de Tesorerías", "6536"),
    ("CONAF", "DL 701", "Ley de Fomento Forestal", "6294"),
    ("SERNAC", "Ley 19.496", "Ley de Protección de los Derechos de los Consumidores", "61438"),
    ("Defensoría Penal Pública", "Ley 19.718", "Ley de la Defensoría Penal Pública", "182533"),
    ("FONASA", "DFL 1 (Salud, 2005)", "Ley que refunde textos sobre régimen de salud (FONASA)", "249177"),
    ("Servicio Médico Legal", "DFL 196 (Justicia)", "Ley Orgánica del Servicio Médico Legal", "4832"),
    ("ChileCompra", "Ley 19.886", "Ley de Bases sobre Contratos Administrativos de Suministro y Prestación de Servicios", "213004"),
    ("INDAP", "DFL 13 (Agricultura)", "Ley Orgánica del Instituto de Desarrollo Agropecuario", "3297"),
    ("SAG", "Ley 18.755", "Ley Orgánica del Servicio Agrícola y Ganadero", "29961"),
    ("SENAME", "DL 2.465", "Ley Orgánica del Servicio Nacional de Menores", "6929"),
    ("INE", "DL 3.551", "Ley del Instituto Nacional de Estadísticas", "7121"),
    ("Servicio Electoral", "Ley 18.556", "Ley Orgánica del Servicio Electoral", "29951"),
    ("Superintendencia de Salud", "DFL 1 (Salud, 2005)", "Ley sobre régimen de prestaciones de salud", "249177"),
    ("Superintendencia de Educación", "Ley 20.529", "Sistema Nacional de Aseguramiento de la Calidad de la Educación", "1028635"),
    ("CORFO", "DFL 211 (Hacienda)", "Ley Orgánica de CORFO", "4804"),
    ("Servicio de Salud", "DFL 1 (Salud, 2005)", "Ley que fija texto refundido del DL 2.763 (Salud)", "249177"),
)
#: Words of titles that stay in capitals.
TITLE_CAPITALS = (
    "rrhh", "tic", "ti", "qa", "ux", "ui", "it", "pm", "api", "sql", "sap", "erp", "crm", "bi", "seo", "sem", "upc", "uci", "sapu", "aps", "slep", "cmsc", "sence", "minsal", "mineduc", "minvu",
    "mop", "mma", "mtt", "segpres", "cft", "ip", "dgac", "conaf", "sernac", "sernapesca", "sernatur", "sernam", "indap", "inia", "corfo", "fosis", "sii", "srcei", "sag", "sml", "senama",
    "senapred", "ffaa", "pdi", "gope", "dmc", "dom", "dideco", "daem", "dgac", "oirs", "asistente", "eus", "esu", "eur", "icp", "etcp", "hep", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix",
    "x",
)
#: Words of titles with a spelling of their own.
TITLE_PROPER = {
    "chile": "Chile", "santiago": "Santiago", "valparaiso": "Valparaíso", "biobio": "Biobío", "araucania": "Araucanía", "o'higgins": "O'Higgins", "nuble": "Ñuble", "magallanes": "Magallanes",
    "aysen": "Aysén", "tarapaca": "Tarapacá", "antofagasta": "Antofagasta", "coquimbo": "Coquimbo", "maule": "Maule", "los": "Los", "rios": "Ríos", "lagos": "Lagos", "excel": "Excel",
    "python": "Python", "java": "Java", "javascript": "JavaScript", "typescript": "TypeScript", "react": "React", "node": "Node", "aws": "AWS", "power": "Power", "office": "Office",
}
#: Words that stay small inside a title.
TITLE_SMALL = (
    "de", "del", "la", "las", "el", "los", "y", "e", "en", "para", "con", "por", "al", "a", "o", "u", "sin",
)
#: Words of titles that take accents.
TITLE_ACCENTS = {
    "tecnico": "técnico", "tecnica": "técnica", "administracion": "administración", "organizacion": "organización", "enfermeria": "enfermería", "campana": "campaña",
    "imagenologia": "imagenología", "farmacia": "farmacia", "gestion": "gestión", "publica": "pública", "analisis": "análisis", "clinica": "clínica", "logistica": "logística",
    "academica": "académica", "programacion": "programación",
}
#: Words whose full stop ends no sentence.
ABBREVIATIONS = (
    "dr", "dra", "drs", "sr", "sra", "srta", "srs", "sres", "sras", "prof", "ing", "lic", "arq", "téc", "tec", "mag", "mg", "mgr", "ph", "phd", "univ", "u", "ud", "uds", "dn", "don", "doña",
    "dona", "art", "n", "no", "núm", "num", "cap", "pág", "pag", "av", "avda", "cía", "cia", "ltda", "spa", "depto", "dpto", "fac", "adm", "admin", "asist", "aux", "eus", "esu", "apu", "apr",
    "apt", "slep", "cmsc", "sercotec", "minsal", "mineduc", "minjus",
)
#: Search terms and what they also find.
SYNONYMS = {
    "RRHH": ("Recursos Humanos", "Gestión de Personas", "Capital Humano"), "Recursos Humanos": ("RRHH", "Gestión de Personas", "Capital Humano"),
    "TI": ("Tecnología", "Informática", "Sistemas", "IT", "Computación"), "Informática": ("TI", "Tecnología", "Sistemas", "IT"), "IT": ("TI", "Tecnología", "Informática", "Sistemas"),
    "Contabilidad": ("Contable", "Finanzas", "Contador"), "Contador": ("Contabilidad", "Contable", "Finanzas"), "Abogado": ("Jurídico", "Legal", "Derecho"),
    "Legal": ("Abogado", "Jurídico", "Derecho"), "Jurídico": ("Abogado", "Legal", "Derecho"), "Enfermería": ("Enfermera", "Enfermero", "TENS"), "TENS": ("Técnico en Enfermería", "Enfermería"),
    "Psicólogo": ("Psicología", "Salud Mental"), "Psicología": ("Psicólogo", "Salud Mental"), "Asistente Social": ("Trabajo Social", "Trabajadora Social", "Trabajador Social"),
    "Trabajo Social": ("Asistente Social", "Trabajadora Social"), "Ingeniero": ("Ingeniería", "Ingeniera"), "Ingeniera": ("Ingeniería", "Ingeniero"),
    "Administrativo": ("Administrativa", "Administración", "Secretaria"), "Secretaria": ("Secretario", "Administrativo", "Administrativa"),
    "Médico": ("Medicina", "Doctor", "Doctora", "Médica"), "Kinesiólogo": ("Kinesiología", "Kinesióloga"), "Nutricionista": ("Nutrición",), "Odontólogo": ("Odontología", "Dentista"),
    "Paramédico": ("Paramédica", "TENS"), "Matrona": ("Matrón", "Obstetricia"), "Conductor": ("Chofer",), "Chofer": ("Conductor",), "Auxiliar": ("Auxiliar de Servicio", "Auxiliar de Aseo"),
    "Planta": ("Titular", "Titularidad"), "Contrata": ("Contrato a contrata",), "Honorarios": ("Honorario", "A honorarios", "Boleta de honorarios"), "ADP": ("Alta Dirección Pública",),
    "Municipalidad": ("Municipio", "Municipal", "Ilustre Municipalidad"), "Municipio": ("Municipalidad", "Municipal"),
}
#: Acronyms of titles that always stand in capitals.
TITLE_ACRONYMS = ("SLEP", "CMSC", "SENCE", "MINSAL", "MINEDUC", "MINVU", "SEGPRES", "CFT", "DGAC", "CONAF", "CORFO", "FOSIS", "SII", "SRCEI", "SAG", "SML", "SENAMA", "SENAPRED", "FFAA", "PDI", "DAEM", "DIDECO", "DOM", "OIRS", "IP", "UCI", "UPC", "SAPU", "APS", "EUS", "ESU", "RRHH", "TIC", "ERP", "CRM", "API", "SQL")
