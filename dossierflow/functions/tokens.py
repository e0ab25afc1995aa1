"""Word lists and constants that results depend on."""

#: Fixed values.
CATEGORIES = ("vivo", "da-consultare", "archivio", "cestino", "da-chiarire")
LEGAL_FORMS = (" srl", " s.r.l.", " spa", " s.p.a.", " sas", " s.a.s.", " snc", " s.n.c.", " sa", " srls")
RED_FLAG_NAMES = ("copia di", "copia di copia", "copy of", "untitled", "senza titolo", "nuovo documento", "_old", ".bak", ".tmp", "~$")
ARCHIVE_PATHS = (
    "_archivio", "/archivio", "vecchio", "vecchi", "old/", "_old", "_old_", "/backup", "_backup", "backup_2",
    "storico", "obsoleto", "non_usare", "non usare", "_da_eliminare",
)
LIVE_PATHS = (
    "/attivi", "/aperti", "/in-corso", "/in_corso", "/wip", "/vivi", "/commerciale", "/clienti/", "/fornitori/", "/offerte/",
    "/ordini/", "/fatture/", "/ddt/", "/comunicazioni/", "/preventivi/", "/commesse/", "/progetti/",
)
CONSULT_PATHS = (
    "/contratti/", "/listini/", "/manuali/", "/modelli/", "/templates/", "/documenti/", "/normativa/", "/normative/",
    "/policies/", "/policy/", "/procedure/", "/riferimenti/", "/references/", "/anagrafica/", "/anagrafiche/",
)
BUSINESS_NAMES = (
    "fattura", "fatture", "fattura_", "ddt", "ddt_", "offerta", "offerta_", "preventivo", "preventivo_", "conferma_ordine",
    "conferma-ordine", "ordine_", "contratto", "contratto_", "listino", "listino_", "manuale", "manuale_", "anagrafica",
    "anagrafica_", "contatti", "scheda_cliente", "scheda_fornitore", "riepilogo", "report", "relazione", "comunicazione",
    "perizia", "verbale",
)
SOURCE_PRIORITY = {"gdrive": 50, "m365": 40, "nas": 30, "email-attachment": 20, "server": 15, "email": 10}
FOLDER_TYPES = {
    "client": "cliente", "clienti": "cliente", "customer": "cliente", "fornitor": "fornitore", "fornitori": "fornitore",
    "supplier": "fornitore", "commess": "commessa", "commesse": "commessa", "project": "commessa", "progett": "commessa",
}
GENERIC_DOMAINS = (
    "gmail.com", "yahoo.it", "yahoo.com", "libero.it", "hotmail.it", "hotmail.com", "outlook.it", "outlook.com", "pec.it",
    "tin.it", "tiscali.it", "alice.it", "virgilio.it", "icloud.com",
)
MODEL_BELOW, BULK_APPROVE, DORMANT_DAYS, MIN_CLUSTER = 0.5, 0.85, 90, 2
