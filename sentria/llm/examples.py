"""Labelled examples by rule: what messages, notices, filler, refusals and ordinary sentences are like.

Each pattern stands for many wordings; ``made`` draws some of them, always the same ones. They are
written from what is publicly known of such messages (the phrases of HTTP, what browsers and
templates say), and what the models learn from them is tested on other wordings.
"""

from __future__ import annotations

import random
import string

from sentria.llm.wording import expand

STATUS = "(400 Bad Request|401 Unauthorized|403 Forbidden|404 Not Found|405 Method Not Allowed|408 Request Timeout|410 Gone|429 Too Many Requests|500 Internal Server Error|501 Not Implemented|502 Bad Gateway|503 Service Unavailable|504 Gateway Timeout)"
PHRASE = "(Bad Request|Unauthorized|Forbidden|Not Found|Request Timeout|Too Many Requests|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout)"
CODE = "(404|500|502|503|7|12ab90f3|0c4e11d2|88|3f9a)"
SCRIPT = "(JavaScript|scripts|cookies|JS|scripting)"

ERROR = (
    f"(HTTP |)(Error|Status|Code|) {STATUS}(.|)", f"{STATUS}(.| -|:) (The|This) (requested |)(page|URL|resource|file|document) (/a/{CODE} |)(was not found|does not exist|could not be found|has been removed|has moved|is gone)( on this server|).",
    f"{PHRASE}. (The request|Request|Trace|Incident) {CODE} (was logged|was saved|has been recorded); (contact|please contact|notify) (the|your) (site |)(administrator|webmaster|support team).",
    "The (server|service|application) (encountered|reported|met) an? (internal|unexpected|unknown) error( and (could not|was unable to) complete your request|).",
    "The (server|upstream server|gateway|host|proxy|remote host|database|upstream service) (did not respond|is not responding|closed the connection|refused the connection|timed out|is unavailable|is overloaded|did not answer)( in time|).",
    "(An|An unexpected|An unknown|A fatal) error (has |)(occurred|happened)( while (processing|handling) (your|the) request|).( Please try again( later|).|)",
    "(Oops|Whoops|Sorry|Uh-oh)! (Something (went wrong|broke)|That page (is missing|does not exist)|We (hit a problem|could not find that page))( on our (side|end)|)(.|!)",
    "(Please |)(try again|retry|reload|refresh|refresh the page|reload this page|come back) (later|in a few (minutes|moments|seconds)|shortly).", f"(Reference|Request|Trace|Incident|Ticket|Error|Support)( ID| code| number|): {CODE}",
    "(Access|Permission) (denied|refused|to this page is denied). You (do not|don't) have (permission|the rights|access|authorization) to (view|see|open|edit|use) this (page|file|document|resource|directory).",
    "(Your|The) session (has expired|has timed out|has ended|is no longer valid)(.|, please (log|sign) in again.)", "(We are|The site is|This service is|Our systems are) (currently |)(down|offline|closed|unavailable) (for|due to) (scheduled |)(maintenance|an upgrade).( We will be back soon.|)",
    f"(Too many requests|Rate limit (exceeded|reached)|Quota exceeded)(,|.|:) (retry|try again|wait|slow down and try again)( after| for) {CODE} seconds.", f"HTTP (response|status|code) (code |){CODE} (was sent|came back|was received|from the server|received from the proxy).",
    f'(Runtime|Value|Type|Key|Index|Timeout|Connection|Syntax|Null Pointer|IO)(Error|Exception): (worker|request|object|key|connection|thread) {CODE} (not found|failed|lost|timed out|is null)', f'Traceback (most recent call last): File "(app|main|run|server).py", line {CODE}, in (main|handle|run|load)', f'Exception in thread "main" java.lang.(RuntimeException|NullPointerException): {CODE}',
    f'{{"(error|status|fault)": {{"(code|status|id)": {CODE}, "(message|detail|reason)": "(not found|timeout|server overloaded|bad request|internal error|unavailable)"}}}}', "(The |This |)(model|engine|backend|API) (is|was) (overloaded|unavailable|not available|busy)(, (try|please try) again( later|)|).", "(No|Empty) (response|output|text|content|result) (was |)(received|generated|returned|produced)( by the (model|server)|).", "(Fatal error|Fatal|Warning|Error): (out of memory|maximum execution time exceeded|failed to (open|load|connect)|cannot (open|load|connect)).",
    "This (site|page|webpage) (cannot|can't|can not) be (reached|displayed|opened|loaded|found).( The connection (was reset|timed out|was refused).|)", "The (page|link|address|file) you (requested|followed|are looking for|entered) (is broken|may have (moved|been removed)|is no longer available|does not exist).", "(Connection|Request|Operation) (timed out|was reset|refused|failed|aborted).",
    f"(Fehler|HTTP-Fehler) {CODE}: (Seite|Datei|Dokument) (nicht gefunden|nicht vorhanden).", "(Die|Diese) (Seite|Datei|Adresse) (wurde nicht gefunden|existiert nicht( mehr|)|ist (nicht erreichbar|veraltet)|konnte nicht geladen werden).", "(Interner Serverfehler|Zugriff verweigert|Zeitüberschreitung|Dienst nicht verfügbar|Der Server antwortet nicht|Ein Fehler ist aufgetreten)(.|, bitte versuchen Sie es später( erneut|).)", "Der Link ist (veraltet|falsch|ungültig|defekt|abgelaufen).",
    f"Erreur {CODE}( :|,) (page (introuvable|non trouvée)|accès refusé|service indisponible|le serveur ne répond pas).", "(La page|Le fichier|Le service|Le serveur) (demandée? |)(est introuvable|n'existe pas|est indisponible|ne répond pas|est en maintenance).", "(Une erreur (interne |)est survenue|Accès refusé|Délai dépassé)(.|, (veuillez réessayer|réessayez) plus tard.)",
    "(Página|Archivo|Documento) no (encontrada|encontrado|disponible|existe).( (Vuelva|Regrese) (al inicio|a la página principal).|)", f"(Error {CODE}: |)(el servidor no responde|acceso denegado|servicio no disponible|error interno del servidor|tiempo de espera agotado)(.|, (inténtelo|vuelva a intentarlo) más tarde.)", "(Pagina|Risorsa) non (trovata|disponibile).( Errore (interno |)del server.|)", "(Página|Recurso) não (encontrada|encontrado).( Erro (interno |)do servidor.|)", f"(Código|Referencia|Codice|Kennung|Référence|Vorgang) {CODE}",
)
NOTICE = (
    f"(Please |Kindly |)(enable|turn on|activate|allow|unblock) {SCRIPT}( in your (browser|settings)|) (to|in order to) (continue|proceed|view (this|the) (page|site|content|article)|use this (app|site|website)|load the (page|content)).", f"(You (need|will need|have|must)|Users have|Visitors need) to (enable|turn on|switch on|allow|activate) {SCRIPT}( in your browser|) to (run|use|open|see) this (app|page|site|website|document).",
    f"{SCRIPT} (is|are|appears to be|seems to be|must be|needs to be) (disabled|turned off|blocked|switched off|not enabled|required|needed|enabled|allowed|activated)( in your browser| on this (page|device)| for this site|).", "This (site|page|app|website|content|form) (requires|needs|relies on|depends on|works only with|will not work without) (JavaScript|scripts|cookies|a modern browser)( to (work|function)( properly|)| enabled|).",
    "Your browser (is out of date|is not supported|is too old|does not support (scripts|this feature)|blocks (scripts|cookies)|has (scripts|cookies|JavaScript) (disabled|turned off)).( Please (update|upgrade)( it|).|)", "(Checking|Verifying|We are checking) (your browser|that you are (human|not a robot)|the security of your connection)( before (you proceed|opening the site|loading)|)(...|, please wait.|. This may take a few seconds.)", "(Loading|Please wait|One moment please|Redirecting|Still loading|Now loading|Page loading)( the page|)(...|…)",
    "(We|This site) (use|uses) cookies( and similar technologies|) to (improve your experience|analyse traffic|remember you).( (Accept all|Reject all|Manage settings).|)", f"(The|This) (content|page|text|article) (cannot|can't|could not|can not) be (shown|displayed|rendered|opened) (without|while you block|if you disable) {SCRIPT}.", f"(Nothing|No content) (to (see|display)|can be shown|is available) (without|unless you allow) {SCRIPT}.", "(It (looks|seems) (as if|like)|We noticed that) (scripts|cookies|JavaScript) (are|is) (off|disabled|blocked|turned off)( in this browser|).", f"(noscript|<noscript>)(:|) (the|this) (page|site|app) is (built|drawn|rendered) (by|with|in) (JavaScript|scripts|the browser).", f"(Switch|Turn|Set) {SCRIPT} (on|back on)( in your browser|)( and reload|).", "Some (functions|parts|features) of this (page|site) (need|require) (JavaScript|scripts|cookies).",
    "(Bitte |)(aktivieren|erlauben|schalten) Sie (JavaScript|Skripte|Cookies)( in Ihrem Browser|)( ein|), um (fortzufahren|die Seite (anzuzeigen|zu nutzen)|den Inhalt zu laden).", "(JavaScript|Skripte|Cookies) (ist|sind|wird|werden) (deaktiviert|erforderlich|blockiert|benötigt|ausgeschaltet).", "Ihr Browser (wird nicht unterstützt|ist veraltet|blockiert (Skripte|Cookies)).", "(Wird geladen|Bitte warten|Seite wird geladen)(...|…)",
    "(Veuillez |Merci d'|)(activer|autoriser) (JavaScript|les scripts|les cookies)( dans votre navigateur|) (pour|afin de) (continuer|afficher (la|cette) page|voir le site).", "(JavaScript|Les cookies) (est|sont) (désactivé|désactivés|nécessaire|requis|bloqués).", "Votre navigateur (n'est pas pris en charge|est obsolète|bloque les scripts).", "(Chargement|Veuillez patienter)( en cours|)(...|…)",
    "(Por favor, |Para (seguir|ver la página), |)(active|habilite|permita|activa) (JavaScript|los scripts|las cookies)( en su navegador|) para (continuar|ver (esta|la) página|usar el sitio).", "(JavaScript|Las cookies) (está|están) (desactivado|desactivadas|bloqueadas).", "Su navegador (no es compatible|está obsoleto|bloquea los scripts).", "(Abilitare|Attivare) (JavaScript|i cookie)( nel browser|) per (continuare|vedere la pagina).", "(Ative|Habilite) (o JavaScript|os cookies)( no navegador|) para (continuar|ver a página).", "(Cargando|Espere por favor|Caricamento|Carregando)(...|…)",
)
FILLER = (
    "(Sample|Dummy|Placeholder|Example|Filler|Mock|Dummied) (text|copy|content|paragraph|essay|article)( for (the|this) (layout|page|design)|)( only|)(.|; (replace|do not publish|ignore)( it|).)", "(Your|Add your|Insert your|Type your|Enter your|Put your|Write your) (text|title|heading|content|story|essay|paragraph|subtitle|summary) here(.|)", "(Your|The|An? (opening|first|final)|Some) (title|heading|intro|introduction|conclusion|sentence|paragraph|quote|content|description|point) (goes|comes|belongs) here(.|)",
    "(This|The following) (is|paragraph is|text is|page holds) (just|only|merely|)( |)(dummy|placeholder|filler|sample|demo) (text|copy|content)( (to fill space|for the layout|to be replaced|that will be replaced|that nobody should read)|).", "(Replace|Overwrite|Swap) (this|it|the text)( paragraph| block|) (with|by) (the|your) (final|real|own|actual) (text|copy|version|content)( later|).", "(Click|Double-click|Tap)( here|) to (edit|add|change) (this |)(text|title|paragraph|content).", "(Text|Content|Copy|Essay|Paragraph) (to be (written|added|supplied|replaced)|coming soon|to follow|TBD|TBA)( later|).", "(test|testing) (test|testing|one two three|1 2 3)( (please |)ignore( this|)|)", "(This|The) (block|paragraph|section) (stands in for|only holds the place of|takes the place of) the (real|final|actual) (one|text)( and will (go|be replaced|change)|).", "about (200|300|500) words, (two|three|four) paragraphs", "(Nothing|No part) (in|of) (it|this) is meant to be (published|understood|used).",
    "(Blindtext|Platzhalter|Platzhaltertext|Fülltext|Beispieltext|Mustertext|Dummytext)(:|,|.|) (hier (folgt|steht|kommt) (später|noch|bald|dann) (der|ein) (eigentliche|endgültige|echte) (Text|Inhalt|Aufsatz)|wird (noch |)ersetzt|bitte (noch |)ersetzen|nicht (lesen|veröffentlichen)).", "(Texte|Faux texte|Texte provisoire|Texte de remplissage|Texte d'exemple|Texte fictif)(,|.|) (à (remplacer|compléter|modifier|supprimer)( plus tard| par le vrai texte|)|en attendant la version finale|ne pas publier).", "(Texto de (relleno|ejemplo|prueba|muestra)|Texto (provisional|ficticio))(,|.|) ((Sustituir|Reemplazar|Cambiar|Borrar) (por el texto (real|final)|antes de (publicar|entregar))|no (publicar|entregar)).", "(Testo (segnaposto|di prova|di riempimento|fittizio))(,|.|) (da sostituire|da completare|non pubblicare).", "(Texto (de preenchimento|de exemplo|fictício))(,|.|) (substituir|trocar|não publicar).",
    "(Lorem|Lorem ipsum|Lipsum)( text| dolor| dolor sit amet|)( here|)(.|)",
)
#: The passage that filler text comes from, of the first century BC.
CICERO = (
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt "
    "neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem ut enim ad minima veniam quis nostrum exercitationem ullam corporis suscipit laboriosam nisi ut aliquid ex ea commodi consequatur quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur vel illum qui dolorem eum fugiat quo voluptas nulla pariatur"
).lower().split()
#: How three other old Latin texts begin.
OLD = (
    "gallia est omnis divisa in partes tres quarum unam incolunt belgae aliam aquitani tertiam qui ipsorum lingua celtae nostra galli appellantur hi omnes lingua institutis legibus inter se differunt gallos ab aquitanis garumna flumen a belgis matrona et sequana dividit horum omnium fortissimi sunt belgae propterea quod a cultu atque humanitate provinciae longissime absunt "
    "arma virumque cano troiae qui primus ab oris italiam fato profugus laviniaque venit litora multum ille et terris iactatus et alto vi superum saevae memorem iunonis ob iram multa quoque et bello passus dum conderet urbem inferretque deos latio genus unde latinum albanique patres atque altae moenia romae "
    "quo usque tandem abutere catilina patientia nostra quam diu etiam furor iste tuus nos eludet quem ad finem sese effrenata iactabit audacia nihilne te nocturnum praesidium palati nihil urbis vigiliae nihil timor populi nihil concursus bonorum omnium nihil hic munitissimus habendi senatus locus nihil horum ora voltusque moverunt"
).split()
#: The usual filler that is made of it.
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum".split()
#: The rows of letters of a keyboard.
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

WHO = "(I|We|My aunt|Our captain|The coach|She|He|My friend|The librarian|Our teacher|Everyone|My brother|Nobody|The neighbours)"
THING = "(the lamp|a letter|our old radio|the wooden box|my bicycle|a page of the diary|the map|a broken clock|the garden gate|the blue kettle|the text of the song|the script of the play|a sample of the soil|the title of the book|the server in the restaurant|his browser|the website|the test)"
PLACE = "(near the harbour|in the kitchen|behind the school|at the station|on the roof|next to the library|under the bridge|in room 12|at the market|by the river|on page 7|at the office)"
DID = "(carried|painted|found|lost|repaired|copied|opened|closed|sold|watched|remembered|forgot|moved|measured|loaded|replaced|returned|typed|tested|enabled|allowed)"
WHY = "(because it was late|after the storm|and everyone laughed|although nobody asked|before the concert|so we went home|while it rained|and I learned to wait|which taught me patience|when the power failed)"
FEELS = "(friendship|courage|silence|hope|failure|freedom|teamwork|curiosity|kindness|discipline|memory|privacy)"
ORDINARY = (
    f"{WHO} {DID} {THING} {PLACE} {WHY}.", f"{WHO} {DID} {THING} {PLACE}.", f"{PLACE} {WHO} {DID} {THING}, (and|but|so) {WHO} {DID} {THING}.", f"(Schools|Students|Parents|Towns|Teachers) (should|must|could|can|need to) (offer|protect|question|support|improve|allow|require) {FEELS} because (it|that) (matters|helps everyone|is not easy|takes time).", f"(I think|In my opinion|I learned|It showed me|We believe) that {FEELS} (is|was|becomes|comes before|depends on) {FEELS}.", f"(Nobody|Everyone|We all|I|She|He) (answered|waited|laughed|left|stayed|agreed|smiled|spoke|moved|listened).", "(So|Then|And|But|Still,|Finally,) (I|we|they) (stayed|left|won|waited|tried again|slept|went home|kept going).", f"(What|Why|How|Where) (did|would|could) {WHO} (do|say|find|change) (without|with|about) {FEELS}?", "(Thank you for (reading|listening)|With love|The end|Yours sincerely|That was enough|It rained|We won|I was nervous|Was it fair)(.|!|?|)", f"(In (second|fifth|ninth) grade|Last winter|One morning|After the finals|That summer), {WHO} {DID} {THING} {PLACE}.",
    "(No|Yes|What|Why|Never|Help|Stop|Wait|Quiet|Oh|Really|Now|Always|Again|Sí|Nein|Ja|Oui|Non|Nunca|Nie)( now| then| not| again|)(!|!!!|?|?!|...|.)", "(Der|Die|Das|Am|Im|Zum|Jeder|El|La|Le|The|No|Vol|Fig|art|núm|Nr) (2|3|7|12|65).", f"{WHO} {DID} (approx|ca|vol|no|fig)( 12|).",
    # of messages, but no messages
    f"(The|Our|My) (screen|letter|phone|laptop|page|teacher|draft|poster) (only |still |once |)(said|told us|read|showed) that (the page was (missing|not found)|something was wrong|it was loading|the site was down|the text was a sample), (so|and) (I|we) (left|waited|laughed|went home).", f"(My|Our|The) (server|computer|phone|browser|website) once (returned|showed|gave|sent) (a|an|us a) (404|500|502|strange|long) (error|message|page) (in front of|before|to) (us|the class|everyone|my aunt).", f"(Room|Chapter|Page|Bus|Locker|Seat|Problem|House|Highway) (404|500|502|503|12|7) (was|is|had) (the|a|my|our) (quiet|favourite|noisy|old|last) (stadium|room|place|one|kitchen|story).", f"I (taught|showed|told|asked|explained to) my (aunt|uncle|brother|friend|teacher) (why|how|when) (the browser|a website|that page|the app) (asks|wants|needs) (us |you |)to (enable|allow|load|accept) (JavaScript|cookies|scripts|pages).", f"{WHO} (typed|read|wrote|saw|copied|heard) (lorem ipsum|access denied|page not found|please wait|enable cookies|placeholder text|an error message) (on|in|into|from) (page 7|the letter|the screen|our draft|a poster) (and|so|but) {WHO} (laughed|left|went on|forgot it|kept reading).", f"(Our|My|The) (draft|poster|letter|report) (still |)(said|had|showed) (lorem ipsum|dummy text|a placeholder|your name here|sample text) (on|in|at) (page 12|the first line|the end), and (we|I|everyone) (laughed|noticed|fixed it).", f"(Servers|Browsers|Websites|Scripts|Errors|Cookies|Phones|Computers|Screens) (weaken|improve|teach|change|need|make) (our |)(routine|attention|patience|{FEELS}).", "(Bake|We baked|She sold|He ate) (the |)cookies (with|for|before|after) (my aunt|the class|the concert|dinner).", "(She|He|My uncle) was a (server|page|tester|script writer) (in|at) (a restaurant|the court|the theatre|our town).", "We had to (wait|reload the truck|refresh the paint|retry the experiment|come back) (in a few minutes|later|after lunch) (because|since|as) (it rained|the paint was wet).",
    "(Mi tía|El vecino|Nuestra maestra|La capitana|Un amigo|El pueblo) (encontró|perdió|pintó|abrió|llevó|guardó|devolvió|dibujó) (la lámpara|el mapa|una carta|la escalera|el violín|la página del diario) (en el mercado|junto al río|en la cocina|bajo el puente|cerca de la escuela)(, y (aprendí|entendí|creo) que la (amistad|práctica|esperanza|curiosidad) (vale más|empieza antes|no sustituye al esfuerzo)|).", "(Aprendí|Entendí|Todavía creo) que (la amistad|la disciplina|el esfuerzo|la libertad) (vale más que|no sustituye a|se parece a|empieza con) (la práctica|la esperanza|el talento).", "(¿Por qué|¿Cuándo|¿Dónde) (vendió|perdió|dejó) (mi tía|el vecino) (el motor|la manta) (en la estación|dentro del faro)?",
    "(Mein Großvater|Unsere Lehrerin|Der Schneider|Meine Tante|Ein alter Seemann|Die Nachbarin) (rettete|malte|öffnete|verlor|trug|tauschte|versteckte|zahlte) (den Koffer|die Uhr|einen Brief|die Decke|das Rezept|die Karte|die Seite aus dem Heft) (im Keller|am Hafen|neben dem Stall|auf dem Markt|vor der Bäckerei)(, und (ich lernte|wir wussten), dass (Freiheit|Mut|Hoffnung|Geduld) (leise|wichtig|schwer) (ist|bleibt)|).", "(Ich lernte|Wir glauben|Ich denke), dass (Freundschaft|Mut|Geduld|Freiheit) (mehr zählt als|mit|ohne) (Talent|Übung|Hoffnung) (beginnt|bleibt|).",
    "(Ma tante|Le voisin|Notre professeur|La capitaine|Mon frère|Le couturier) (trouva|perdit|peignit|ouvrit|porta|rangea|vendit) (la lampe|la carte|une lettre|l'échelle|le violon|la page du journal) (au marché|près de la rivière|dans la cuisine|sous le pont|derrière l'école)(, et (j'ai appris|je crois) que (l'amitié|le courage|la patience) (compte plus que|commence avant) le talent|).", "(J'ai compris|Je crois|On apprend) que (l'espoir|la liberté|la mémoire) (ne remplace pas|ressemble à|dépend de) (l'effort|la pratique|la patience).",
    "(La mia zia|Il vicino) (trovò|aprì|dipinse) (la lampada|una lettera|la mappa) (al mercato|in cucina|vicino al fiume).", "(A minha tia|O vizinho) (encontrou|abriu|pintou) (a lâmpada|uma carta|o mapa) (no mercado|na cozinha|perto do rio).",
)

TASK = "(this|that|your|the|such an?) (essay|text|request|task|question|assignment|paragraph|topic|story|homework|prompt)"
MAKE = "(write|produce|create|generate|complete|provide|compose|answer|help with|assist with|help you with|continue with|go on with|respond to|rework|fulfil)"
UNABLE = "(cannot|can't|can not|am unable to|am not able to|won't be able to|will not be able to|am not allowed to|am not permitted to|would rather not|prefer not to|will not|do not feel able to)"
OPENER = "(I'm sorry, but |I am sorry, but |I'm afraid |I am afraid that |Sorry, |Sorry, but |Unfortunately, |Regrettably, |I apologize, but |My apologies; |As an AI, |As an AI language model, |As a language model, |As an AI assistant, |As a virtual assistant, |Thank you for asking, but |I understand what you want, but |I appreciate your message; however, |Honestly, |To be honest, |With all respect, |)"
REFUSAL = (
    f"{OPENER}I {UNABLE} {MAKE} {TASK}( for you|).", f"{OPENER}I {UNABLE} {MAKE} {TASK}( for you|).", f"{OPENER}I (must|have to|need to|will have to|am going to have to) (decline|refuse|pass|stop here|turn this down|say no)( to (this|that) (one|request)| on (this|that)( one| task|)|).", f"{OPENER}I('m| am) not (comfortable|able|willing|allowed|in a position) (to {MAKE}|{MAKE}|writing|answering|producing|helping with) {TASK}.", f"{OPENER}I (do not|don't) have (personal |lived |real |)(experiences|memories|feelings|opinions|a life)( (to (write|draw|tell) (about|on|of)|of my own)|).", f"{OPENER}(this|that|{TASK}) (is|falls|goes|would be) (something I (cannot|can't) (do|help with|answer)|outside what I can (do|offer)|against (my|the) (guidelines|policy|policies|rules|principles)|not something I (can|am able to) (do|help with)|beyond what I can do).", f"{OPENER}(nothing|no text|no answer) (that |)I (can|could|am able to) (write|say|give|provide)( here| about this|) (is|would be|seems) (suitable|right|fitting|helpful).", f"{OPENER}it (is|would be) (not possible|impossible|not appropriate|wrong|inappropriate) for me to {MAKE} {TASK}.",
    f"{OPENER}I('d| would) (prefer|rather|like) not (to |){MAKE} {TASK}.", f"{OPENER}I (won't|will not|would not|am not going to) be (writing|composing|answering|completing|producing|doing) {TASK}.", f"{OPENER}(writing|composing|answering|completing|producing) {TASK} (for you |)(is|would be) (not possible|impossible|not allowed|out of the question|something I have to leave to you)( for me|).", f"{OPENER}(your|this|the) (request|question|task) (has to be|must be|is) (declined|refused|turned down|rejected).",
    "(Please|You may want to|I suggest that you|Try to|Perhaps you should|You should) (ask|consult|talk to|contact|see|speak with) (your|a) (teacher|tutor|doctor|counsellor|professional|parent) (about (this|it)|instead|for help).", "(Is there|Let me know if there is|Do you have) (anything|something) else (that |)I (can|could|may) (help|assist)( you|) with(?|.)", "(Would|If) (another|a different) (topic|question|task) (works|suits|is fine|would help)( for you|), (I can help|I would be glad to help|let me know).", "I hope (that |)you (understand|can understand)( my position|).", "(It is|It would be|You will find it) better to write (it|this|the essay) (yourself|on your own|in your own words).", "(Feel free to|Please|You could|Try to|You might) (rephrase|reword|change|adjust) (the|your) (question|task|request|prompt).",
    "(Lo siento, pero |Lamentablemente, |Por desgracia, |Como modelo de lenguaje, |Como asistente de IA, |Perdona, pero |Me temo que |)no (puedo|me es posible|voy a poder|estoy en condiciones de|tengo permiso para) (escribir|ayudar con|ayudarte con|responder a|continuar con|redactar|completar|atender) (esta|este|tu|la|ese) (redacción|texto|solicitud|tarea|pregunta|tema|ensayo|petición)( por ti|).", "(Debo|Tengo que|Prefiero) (rechazar|declinar|negarme a) (esta|tu|la) (solicitud|tarea|petición|pregunta).", "(Consulta|Pregunta|Habla con|Pide ayuda) a? (tu|un) (profesor|maestra|tutor|médico).", "(Prueba|Inténtalo|Intenta) con (otro tema|otra pregunta).",
    "(Es tut mir leid, aber |Tut mir leid, |Leider |Als Sprachmodell |Als KI |Als KI-Assistent |Bedauerlicherweise |)(kann|darf|werde|möchte) ich (diesen|diese|dieses|deinen|Ihnen bei diesem) (Text|Aufsatz|Frage|Aufgabe|Anfrage|Thema|Bitte) (leider |)nicht (schreiben|beantworten|übernehmen|bearbeiten|erstellen|helfen|fortsetzen|behandeln).", "Ich (muss|möchte) (diese|deine|die) (Anfrage|Bitte|Aufgabe) (leider |)(ablehnen|zurückweisen).", "Ich kann (dir|Ihnen) (dabei|damit|bei dieser Aufgabe) (leider |)nicht (helfen|weiterhelfen).", "(Bitte |)(frag|fragen Sie|wende dich an|sprich mit) (deine|Ihre|eine) (Lehrerin|Lehrkraft).", "(Bitte |)(wähle|versuche|nimm) (ein anderes Thema|eine andere Frage).",
    "(Leider|Bedauerlicherweise|Aus diesem Grund|Als KI) ist es mir (leider |)nicht (möglich|erlaubt|gestattet), (diesen|diese|dieses|deinen) (Text|Aufsatz|Frage|Aufgabe|Anfrage|Thema) zu (schreiben|beantworten|übernehmen|bearbeiten|behandeln).", "(Diesen|Diese|Dieses|Deine) (Text|Aufsatz|Frage|Aufgabe|Anfrage|Thema) (kann|darf|werde|möchte|will) ich (leider |lieber |)nicht (schreiben|beantworten|übernehmen|bearbeiten|behandeln).", "(Esta|Esa|Tu) (solicitud|tarea|pregunta) (va más allá de lo que puedo|no la puedo|es algo que no puedo) (hacer|responder|atender).",
    "(Je suis désolé, mais |Désolé, |Malheureusement, |En tant que modèle de langage, |En tant qu'IA, |Navré, |Hélas, |)(je ne peux pas|je ne suis pas en mesure de|il m'est impossible de|je ne peux malheureusement pas|je n'ai pas le droit de|je ne souhaite pas) (écrire|rédiger|répondre à|aider avec|vous aider avec|traiter|continuer|produire) (ce|cette|votre|cet) (texte|demande|question|sujet|rédaction|tâche|devoir).", "(Je dois|Je préfère) (refuser|décliner) (cette|votre) (demande|tâche|question).", "(Demandez|Adressez-vous|Parlez) à (votre|un) (professeur|enseignant|médecin).", "(Essayez|Choisissez|Prenez) (un autre sujet|une autre question).",
    "(Mi dispiace, ma |Purtroppo |Come modello linguistico, |)non (posso|sono in grado di|mi è possibile) (scrivere|rispondere a|aiutare con) (questo|questa) (testo|domanda|richiesta|tema).", "(Lamento, mas |Infelizmente, |Como modelo de linguagem, |)não (posso|consigo|me é possível) (escrever|responder a|ajudar com) (este|esta) (texto|pergunta|pedido|tema).",
)
#: what declines nothing, though it sounds like it
ACCEPTS = (
    f"I (cannot|can't|could not|couldn't|can hardly) (imagine|forget|believe|remember|explain|sleep|wait|stop thinking about|live without|see) {THING}( {WHY}|).", f"(I'm|I am|I was) (sorry|afraid|unable|not able|not comfortable) (that|to|of|about|when) (we lost|see|the dark|losing|miss|leave) {THING}( {PLACE}|).", f"(Unfortunately|Sadly|Regrettably), (it rained|we lost|nobody came|{WHO} {DID} {THING}).", f"(We|Students|Schools|Parents) (should|must|cannot|should not|do not) (refuse|decline|ignore|stop|allow|answer|write off) {FEELS}( because it matters|).", f"{WHO} (refused|declined|was not allowed|was unable|apologised|said sorry) (to {MAKE} the essay|to help|for {THING}|when we asked) {PLACE}.", f"(Writing|Answering|Reading) (this|an|the) (essay|question|text|story) (taught me|made me think about|was about) {FEELS}.", f"(In this essay|To answer this question|For this assignment|In this paragraph), (I|we) (will|want to|would like to|shall) (argue|show|explain|write|describe) (that|how|why) {FEELS} (matters|helps|grows).", f"(My teacher|My tutor|My doctor|Our professor) (asked|told|helped) me (to write|about|with) (this essay|the question|{THING}).", f"As (a child|an assistant|a student|a model|a captain|an older sister), (I|she|he) {DID} {THING} {PLACE}.", f"(I understand|I appreciate|I respect) {FEELS} (more|better) (than|since|after) {FEELS}.",
    f"I (have to|must|had to) (admit|say|confess|tell you) that (I was (proud|nervous|late|wrong)|{WHO} {DID} {THING}).", f"It (is|was|seemed) (impossible|not possible|wrong|hard|not easy) to (win|see|forget|find|leave) (every game|the end|{THING}|my family).", f"I('m| am) (sorry|proud|afraid|glad) (I|we|that I|that we) (ever|once|never|almost) (doubted|left|forgot|sold|hid) (her|him|them|{THING}).", f"I (was|am) (unable|not able) to (lift|carry|find|reach|open|hear) {THING}( {WHY}|).", "Es (war|ist) mir nicht (möglich|leicht), (die Lampe zu tragen|den Zug zu erreichen|zu schlafen).",
    "(No puedo|No pude) (olvidar|imaginar|creer) (la lámpara|aquella tarde|el viaje)( con mi tía|).", "(Lo siento|Lamentablemente), (llovió|perdimos el partido|nadie vino).", "(Leider|Es tut mir leid, dass) (regnete es|wir das Spiel verloren|niemand kam).", "Ich kann (den Abend|die Lampe|das Meer) nicht (vergessen|sehen|tragen).", "(Malheureusement|Hélas), (il pleuvait|nous avons perdu|personne n'est venu).", "Je ne peux pas (oublier|imaginer|porter) (la lampe|cette journée|le violon).",
)

#: what is asked for
REQUEST = (
    f"(Answer|Discuss|Consider|Think about|Respond to) the (question|prompt|passage|statement)( below| that follows|):( (Should|Is|Can|Does) {FEELS} (matter|help|change) (us|towns|schools)?|)", f"(Question|Task|Topic|Q|Prompt): (Should|Is|Does|Can|Why is) (every school|{FEELS}|a town) (own|more important than|help|teach|keep) (a garden|{FEELS}|students)?", "(Imagine|Suppose|Pretend) (that |)you (are|were) (seventeen|a captain|a mayor|applying to a college|writing to a friend).", "(Write|Compose|Draft) (an essay|a paragraph|a story|300 words|a letter) (about|on|for) (your|a|the) (first day|school paper|hero|trip|town).", "(Rewrite|Rework|Improve|Polish|Edit) (the|this) (paragraph|text|passage)( so that it reads better|).", "(Take a position|Use examples|Give reasons|Explain your answer|Support your view)( and defend it| with examples|).",
    "(Pregunta|Tema|Tarea): ¿(Debería|Es|Puede) (la escuela|la amistad|el silencio) (más importante|enseñar|ayudar)?", "(Escribe|Redacta) (un ensayo|un texto|una carta) (sobre|acerca de) (tu|una|la) (escuela|amistad|viaje).", "(Frage|Thema|Aufgabe): (Ist|Soll|Kann) (Ehrlichkeit|die Schule|Mut) (wichtiger als|mehr) (Stille|Freiheit|helfen)?", "(Schreibe|Verfasse) (einen Aufsatz|einen Text|einen Brief) über (deine|die) (Schule|Freundschaft|Reise).", "(Question|Sujet|Tâche)\u00a0: (Faut-il|Est-ce que|Peut-on) (l'école|l'amitié|le silence) (compte|enseigner|aider)\u00a0?", "(Écris|Écrivez|Rédigez) (un texte|une lettre|une rédaction) sur (ton|votre|l') (école|ami|voyage).",
)

EACH = 30


def made(patterns: tuple[str, ...], each: int = EACH, seed: int = 1) -> list[str]:
    """Wordings of every pattern; some in capitals."""
    rng = random.Random(seed)
    out = []
    for p in patterns:
        for _ in range(each):
            x = expand(p, rng)
            out.append(x.upper() if rng.random() < 0.06 else x)
    return out


def latin(n: int = 500, seed: int = 2) -> list[str]:
    """Sentences of shuffled filler."""
    rng = random.Random(seed)
    out = [" ".join(rng.choices(words, k=rng.randint(4, 14))).capitalize() + "." for words in (CICERO, LOREM, OLD, CICERO + LOREM) for _ in range(n // 4)]
    starts = [(w, k) for w in (CICERO, LOREM, OLD) for k in range(0, len(w) - 6, 3)]
    return out + [" ".join(w[k : k + rng.randint(4, 12)]).capitalize() + "." for w, k in starts]


def keys(n: int = 200, seed: int = 3) -> list[str]:
    """What fingers type that only fill a field."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        row = lambda: (r := rng.choice(KEYS))[(k := rng.randrange(len(r) - 3)) : k + rng.randint(3, 5)]
        words = [row() if rng.random() < 0.8 else rng.choice(string.ascii_lowercase) * 4 for _ in range(rng.randint(2, 7))]
        out.append(" ".join(words + (["test"] * 2 if rng.random() < 0.3 else []) + (["ignore"] if rng.random() < 0.2 else [])))
    return out


def foreign(n: int = 150, seed: int = 4) -> list[str]:
    """Words that no example has, of several scripts, and made-up names: unknown words say nothing."""
    rng = random.Random(seed)
    scripts = [(0x4E00, 0x9FA5, 0), (0x3041, 0x3093, 0), (0x0E01, 0x0E2E, 0), (0x0430, 0x044F, 5), (0x0905, 0x0939, 4), (0x0621, 0x064A, 5), (0x03B1, 0x03C9, 5), (0xAC00, 0xD7A3, 3)]
    out = []
    for k in range(n):
        low, high, size = scripts[k % len(scripts)]
        out.append(" ".join("".join(chr(rng.randint(low, high)) for _ in range(rng.randint(2, size) if size else 12)) for _ in range(rng.randint(1, 8))) + rng.choice(["", ".", "..."]))
    syllables = ["ka", "ro", "vel", "stin", "dru", "mo", "len", "pesh", "tov", "gri", "sal", "wen", "bo", "zik"]
    name = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 3))).capitalize()
    return out + [f"{name()} {rng.choice(['laughed', 'waited', 'shrugged', 'and', 'said', 'rió', 'lachte', 'sourit', 'of', 'de', 'von', 'et', 'art'])} {rng.choice([name(), '7', ''])}." for _ in range(n)]


def fragments(texts: list[str], seed: int = 5) -> list[str]:
    """What is left of ordinary sentences that are torn apart: some of their first or last words."""
    rng = random.Random(seed)
    out = []
    for x in texts[:: max(1, len(texts) // 600)]:
        words, k = x.split(), rng.randint(1, 4)
        out.append(" ".join(words[:k] if rng.random() < 0.5 else words[-k:]))
    return out


def residue() -> list[str]:
    """Errors, notices and filler."""
    return made(ERROR) + made(NOTICE) + filler()


def filler() -> list[str]:
    return made(FILLER) + latin() + keys()


def ordinary(passages: list[str]) -> list[str]:
    """What is no residue: ordinary sentences (passages are more of them), requests, refusals, fragments."""
    whole = made(ORDINARY) + passages
    return whole + made(REQUEST) + made(REFUSAL, 40) + foreign() + fragments(whole)


def refusals() -> list[str]:
    return made(REFUSAL, 60)


def accepted(passages: list[str]) -> list[str]:
    """What declines nothing."""
    whole = made(ORDINARY) + made(ACCEPTS, 60) + passages
    return whole + made(REQUEST) + foreign() + fragments(whole) + made(ERROR, 6) + made(NOTICE, 6)
