"""Word lists of the URL filter and of the quality rules, in English, French, German and Spanish. They are parameters: every operator takes others."""

from __future__ import annotations

#: One of these, as a whole word of a url, is enough to reject it.
URL_STRICT = tuple(
    "porn porno pornos porntube xxx hentai milf milfs camgirl camgirls webcamsex sexcam sexcams upskirt bdsm onlyfans fetish blowjob gangbang "
    "casino casinos kasino onlinecasino spielbank tragamonedas "
    "warez malware phishing spyware ransomware botnet keylogger carding darknetmarket escortgirl escortgirls hookers "
    "putas follar sexo sexe ficken nackt nacktbilder beurette salope xvideos".split()
)
#: Of these, several different ones are needed.
URL_SOFT = tuple(
    "adult adults erwachsene adulte adulto sex sexy sexual nude nudes naked erotic erotik erotica erotique erotico escort escorts dating rencontre citas singles hot babes girls x "
    "bet bets betting wetten pari paris-sportifs apuestas poker slots slot roulette blackjack jackpot bingo lottery lotto loteria loterie gluecksspiel win winner gewinn gagner ganar free gratis gratuit kostenlos bonus prize "
    "crack cracked keygen torrent torrents serial nulled hack hacks cheats pirate "
    "viagra cialis pills pharmacy apotheke farmacia pharmacie steroids weed cannabis "
    "loan loans kredit credito payday forex crypto bitcoin replica cheap discount".split()
)
#: Lines that are nothing else but one of these (with signs around) are boilerplate; patterns.
BOILERPLATE = (
    # English
    r"skip to (?:main )?content", r"accept (?:all )?cookies", r"we use cookies\b.*", r"cookie (?:policy|settings|preferences)", r"manage (?:cookies|consent|preferences)", r"privacy policy", r"terms (?:of use|of service|and conditions)",
    r"sign (?:in|up)(?: now)?", r"log ?(?:in|out)", r"create an account", r"forgot (?:your )?password\??", r"subscribe(?: now| to our newsletter)?", r"read more", r"load more", r"show (?:more|less)", r"click here(?: .*)?", r"learn more",
    r"share (?:this|on)\b.*", r"follow us(?: on .*)?", r"back to top", r"all rights reserved", r"enable javascript\b.*", r"leave a (?:reply|comment)", r"related (?:posts|articles)", r"print this page", r"add to cart", r"home", r"contact us", r"about us",
    # French
    r"aller au contenu(?: principal)?", r"accepter (?:tous )?les cookies", r"nous utilisons des cookies\b.*", r"politique de confidentialité", r"mentions légales", r"conditions (?:d'utilisation|générales)(?: .*)?", r"se connecter", r"s'inscrire", r"connexion",
    r"lire la suite", r"en savoir plus", r"cliquez ici(?: .*)?", r"partager (?:sur|cet article)\b.*", r"haut de page", r"tous droits réservés", r"accueil", r"contactez-nous", r"à propos",
    # German
    r"zum inhalt springen", r"(?:alle )?cookies akzeptieren", r"wir verwenden cookies\b.*", r"diese (?:seite|website) verwendet cookies\b.*", r"datenschutz(?:erklärung)?", r"impressum", r"nutzungsbedingungen", r"anmelden", r"registrieren", r"abonnieren",
    r"weiterlesen", r"mehr (?:lesen|erfahren|anzeigen)", r"hier klicken(?: .*)?", r"teilen auf\b.*", r"nach oben", r"alle rechte vorbehalten", r"startseite", r"kontakt", r"über uns",
    # Spanish
    r"(?:saltar|ir) al contenido", r"aceptar (?:todas las )?cookies", r"(?:usamos|utilizamos) cookies\b.*", r"política de privacidad", r"aviso legal", r"términos y condiciones", r"iniciar sesión", r"regístrate", r"registrarse", r"suscríbete",
    r"leer más", r"ver más", r"haz clic aquí(?: .*)?", r"compartir en\b.*", r"volver arriba", r"todos los derechos reservados", r"inicio", r"contáctanos", r"contacto", r"sobre nosotros",
)
#: Words of menus. A line that is mostly made of them is navigation.
NAVIGATION = frozenset(
    "home about products services blog news contact careers jobs faq help support login logout register signup search sitemap shop store cart checkout account profile forum gallery events archive archives downloads pricing press team partners privacy terms cookies next previous menu categories tags rss "
    "accueil produits actualités emplois aide boutique panier compte recherche connexion suivant précédent galerie événements "
    "startseite produkte leistungen aktuelles karriere hilfe warenkorb konto suche anmelden weiter zurück galerie veranstaltungen impressum datenschutz kontakt "
    "inicio productos servicios noticias empleo ayuda tienda carrito cuenta buscar siguiente anterior galería eventos contacto".split()
)
