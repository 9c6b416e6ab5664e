"""General words of page frames, and phrases of pages without content, in five languages (fixed values).

They are stems and stock phrases of the web at large, not of any one corpus.
"""

from __future__ import annotations


def listed(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(p for line in text.strip().splitlines() for p in line.split("|")))


# Stems of short blocks for sharing, printing and moving about a page.
SHARE = """
share|print|tweet|back to top|skip to
megoszt|nyomtat|vissza a tetej|ugrás a
teilen|drucken|nach oben|zum inhalt
compartir|imprimir|volver arriba|saltar al|ir al contenido
partager|imprimer|haut de page|aller au
"""
# Stems of notices on cookies and consent.
COOKIE = """
cookie|consent|gdpr|privacy|tracker|opt out
süti|adatvédel|hozzájárul
einwillig|datenschutz|privatsphäre
privacidad|consentimiento
confidentialité|consentement|vie privée
"""
# Stock phrases of footers.
FOOTER = """
©|copyright|all rights reserved|newsletter|imprint|terms of use|privacy policy
minden jog fenntartva|impresszum|hírlevél
alle rechte vorbehalten|impressum|nutzungsbedingungen
todos los derechos reservados|aviso legal|boletín
tous droits réservés|mentions légales|lettre d'information
"""
# Errors and refused access.
ERROR = """
404|not found|could not be found|cannot be found|can't be found|does not exist|doesn't exist|no longer exists|no longer available|page is missing|oops|sorry
403|forbidden|access denied|access to this|permission|do not have permission|don't have permission|do not have access|this resource|not authorized|not authorised|unauthorized|unauthorised|session has expired|session expired|session timed out|log in again|sign in|please log in
500|502|503|504|internal server error|server error|internal error|error occurred|an error|something went wrong|bad gateway|bad request|gateway timeout|timed out|upstream|closed the connection|could not connect|handling your request|processing your request|your request
unavailable|not available|under maintenance|maintenance|be back soon|back soon|try again|retry|in a few minutes|too many requests|slow down|rate limit|reference|request id|incident|the address you asked for
hiba|nem található|nem létezik|hozzáférés|jogosultsága|jogosultság|megtekintés|munkamenet|lejárt|nem érhető el|átmenetileg|karbantartás|próbálja|később|azonosító|kérés feldolgozás|jelentkezzen be|keresett oldal|szolgáltatás
fehler|nicht gefunden|existiert nicht|zugriff|verweigert|keine berechtigung|sitzung|abgelaufen|nicht erreichbar|nicht verfügbar|vorübergehend|wartung|versuchen sie|erneut|später|vorgang|melden sie sich|seite|dienst
error|no encontrad|no se encontró|no encontramos|no existe|acceso|denegado|no tiene permiso|permiso|sesión|caducado|expirado|no disponible|por ahora|mantenimiento|inténtelo|intente|más tarde|referencia|inicie sesión|esta página|servicio
erreur|introuvable|n'existe pas|n’existe pas|accès|refusé|interdit|autorisation|autorisé|session|expiré|indisponible|momentanément|maintenance|réessayez|plus tard|référence|reconnectez|cette page|service
"""
# Demands for scripts, loading notices and challenges.
SCRIPT = """
javascript|enable|turn on|scripts|your browser|unsupported browser|to view this|to run this app|reload|refresh the page|this application|this site|cannot be shown|without
loading|please wait|just a moment|redirecting|one moment
verify you are human|you are human|not a robot|a robot|are a person|captcha|checking your browser|checking that you|before accessing|security check|unusual traffic|your network|suspicious activity|ray id|takes a few seconds|must finish|one more step|ddos protection|request
szkript|engedélyezze|böngésző|betöltés|folyamatban|kérjük várjon|alkalmazás|megtekintéséhez|futtatás|ellenőrzés|robot
aktivieren sie|skripte|browser|wird geladen|bitte warten|anwendung|benötigt|sicherheitsprüfung|überprüf|seite anzeigen
active|activar|habilite|guiones|navegador|cargando|espere|aplicación|necesita|ver esta página|comprobación|verificación
activer|activez|navigateur|chargement|en cours|veuillez|patientez|application|a besoin de|afficher|vérification|sécurité
"""
# Filler that stands where text is to come.
FILLER = """
lorem ipsum|dolor sit amet|consectetur adipiscing|sample text|placeholder|text goes here|goes here|your own copy|replace this|your headline|your text|insert text|to follow|text to come|coming soon|under construction|todo|tbd|untitled|undefined|null|nan|dummy text|test test|asdf|qwerty|foo bar
mintaszöveg|ide jön|a szöveg|hamarosan|feltöltés alatt|fejlesztés alatt
beispieltext|mustertext|platzhalter|hier steht|folgt in kürze|im aufbau|demnächst
texto de ejemplo|texto de relleno|próximamente|en construcción|aquí va
texte d'exemple|texte d’exemple|texte à venir|à venir|bientôt|en construction|faux texte
"""
# Words that any sentence of a few words has, by language.
FUNCTION = """
the of and to in a is for on with by at from as that this it be are was were or an its not which has have had
a az és hogy nem is egy volt meg ki ezt mint csak de be el le fel után által szerint számára vonatkozó
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch an nach bei aus über
el la los las de y en que un una por con para del se al su es lo como más o
le la les de des du et en un une que qui dans pour par sur au aux est pas plus avec son sa ses à l d
"""
