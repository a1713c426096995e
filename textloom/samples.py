"""Sample texts from which the default language profiles are learned, written for this purpose. Pass a table of your own to replace them.

Languages with a model (``lexicons.LANGUAGE_MODELS``) can be the outcome of detection; the others are here so that a text in one of them is not taken for its
nearest relative. ``xx`` stands for every script but the Latin one: letters of other scripts are all read as the same sign.
"""

from __future__ import annotations

LANGUAGE_SAMPLES = {
    "en": "The old house stands at the end of the street where we used to play when we were children. In the morning my mother would open the windows and "
          "let the fresh air come in, while my father was reading the newspaper and drinking his coffee. They have lived there for more than thirty years, "
          "and nothing has changed since then. What would you do if you had enough time and money? I think that most people want to be with their friends, "
          "to learn something new every day and to see other countries. It is not always easy to know which way is the right one, but there are things "
          "which should not be forgotten. This is the first of many questions about the world that could be asked here.",
    "de": "Das alte Haus steht am Ende der Straße, in der wir als Kinder gespielt haben. Am Morgen öffnete meine Mutter die Fenster und ließ die frische Luft "
          "herein, während mein Vater die Zeitung las und seinen Kaffee trank. Sie wohnen dort schon seit mehr als dreißig Jahren, und nichts hat sich "
          "verändert. Was würdest du machen, wenn du genug Zeit und Geld hättest? Ich glaube, dass die meisten Menschen mit ihren Freunden zusammen sein "
          "möchten, jeden Tag etwas Neues lernen und andere Länder sehen wollen. Es ist nicht immer einfach zu wissen, welcher Weg der richtige ist, aber "
          "es gibt Dinge, die man nicht vergessen sollte. Das ist die erste von vielen Fragen über die Welt, die hier gestellt werden können.",
    "es": "La casa vieja está al final de la calle donde jugábamos cuando éramos niños. Por la mañana mi madre abría las ventanas y dejaba entrar el aire "
          "fresco, mientras mi padre leía el periódico y tomaba su café. Viven allí desde hace más de treinta años y nada ha cambiado desde entonces. ¿Qué "
          "harías tú si tuvieras bastante tiempo y dinero? Creo que la mayoría de las personas quieren estar con sus amigos, aprender algo nuevo cada día "
          "y conocer otros países. No siempre es fácil saber cuál es el camino correcto, pero hay cosas que no se deben olvidar. Esta es la primera de "
          "muchas preguntas sobre el mundo que se podrían hacer aquí, y también hay otras que son mejores que esta.",
    "fr": "La vieille maison se trouve au bout de la rue où nous jouions quand nous étions enfants. Le matin, ma mère ouvrait les fenêtres et laissait entrer "
          "l'air frais, pendant que mon père lisait le journal et buvait son café. Ils habitent là depuis plus de trente ans et rien n'a changé depuis. Que "
          "ferais-tu si tu avais assez de temps et d'argent ? Je crois que la plupart des gens veulent être avec leurs amis, apprendre quelque chose de "
          "nouveau chaque jour et voir d'autres pays. Il n'est pas toujours facile de savoir quel chemin est le bon, mais il y a des choses qu'il ne faut "
          "pas oublier. C'est la première des nombreuses questions sur le monde que l'on pourrait poser ici.",
    "it": "La vecchia casa si trova alla fine della strada dove giocavamo quando eravamo bambini. Al mattino mia madre apriva le finestre e lasciava entrare "
          "l'aria fresca, mentre mio padre leggeva il giornale e beveva il suo caffè. Abitano lì da più di trent'anni e da allora non è cambiato niente. Che "
          "cosa faresti se avessi abbastanza tempo e denaro? Credo che la maggior parte delle persone voglia stare con gli amici, imparare qualcosa di "
          "nuovo ogni giorno e vedere altri paesi. Non è sempre facile sapere qual è la strada giusta, ma ci sono cose che non si devono dimenticare. "
          "Questa è la prima di molte domande sul mondo che si potrebbero fare qui. Il gatto dorme sul divano e non vuole uscire quando piove.",
    "pt": "A casa velha fica no fim da rua onde brincávamos quando éramos crianças. De manhã a minha mãe abria as janelas e deixava entrar o ar fresco, "
          "enquanto o meu pai lia o jornal e bebia o seu café. Eles moram lá há mais de trinta anos e nada mudou desde então. O que você faria se tivesse "
          "bastante tempo e dinheiro? Acho que a maioria das pessoas quer estar com os seus amigos, aprender alguma coisa nova todos os dias e conhecer "
          "outros países. Nem sempre é fácil saber qual é o caminho certo, mas há coisas que não se devem esquecer. Esta é a primeira de muitas perguntas "
          "sobre o mundo que poderiam ser feitas aqui, e também não são as últimas.",
    "nl": "Het oude huis staat aan het einde van de straat waar wij speelden toen we kinderen waren. 's Morgens opende mijn moeder de ramen en liet de frisse "
          "lucht binnen, terwijl mijn vader de krant las en zijn koffie dronk. Ze wonen daar al meer dan dertig jaar en er is sindsdien niets veranderd. "
          "Wat zou jij doen als je genoeg tijd en geld had? Ik denk dat de meeste mensen bij hun vrienden willen zijn, elke dag iets nieuws willen leren "
          "en andere landen willen zien. Het is niet altijd gemakkelijk om te weten welke weg de juiste is, maar er zijn dingen die je niet moet vergeten. "
          "Dit is de eerste van vele vragen over de wereld die hier gesteld zouden kunnen worden.",
    "sv": "Det gamla huset ligger i slutet av gatan där vi lekte när vi var barn. På morgonen öppnade min mor fönstren och släppte in den friska luften, medan "
          "min far läste tidningen och drack sitt kaffe. De har bott där i mer än trettio år och ingenting har förändrats sedan dess. Vad skulle du göra om "
          "du hade tillräckligt med tid och pengar? Jag tror att de flesta människor vill vara med sina vänner, lära sig något nytt varje dag och se andra "
          "länder. Det är inte alltid lätt att veta vilken väg som är den rätta, men det finns saker som man inte får glömma. Det här är den första av "
          "många frågor om världen som skulle kunna ställas här.",
    "pl": "Stary dom stoi na końcu ulicy, na której bawiliśmy się, kiedy byliśmy dziećmi. Rano moja matka otwierała okna i wpuszczała świeże powietrze, a mój "
          "ojciec czytał gazetę i pił kawę. Mieszkają tam już od ponad trzydziestu lat i od tego czasu nic się nie zmieniło. Co byś zrobił, gdybyś miał "
          "dosyć czasu i pieniędzy? Myślę, że większość ludzi chce być ze swoimi przyjaciółmi, codziennie uczyć się czegoś nowego i zobaczyć inne kraje. "
          "Nie zawsze łatwo jest wiedzieć, która droga jest właściwa, ale są rzeczy, o których nie należy zapominać. To jest pierwsze z wielu pytań o "
          "świat, które można by tutaj zadać.",
    "ro": "Casa veche se află la capătul străzii unde ne jucam când eram copii. Dimineața mama deschidea ferestrele și lăsa să intre aerul curat, în timp ce "
          "tatăl meu citea ziarul și își bea cafeaua. Ei locuiesc acolo de mai bine de treizeci de ani și nimic nu s-a schimbat de atunci. Ce ai face dacă "
          "ai avea destul timp și bani? Cred că cei mai mulți oameni vor să fie cu prietenii lor, să învețe ceva nou în fiecare zi și să vadă alte țări. Nu "
          "este întotdeauna ușor să știi care este drumul cel bun, dar sunt lucruri care nu trebuie uitate. Aceasta este prima dintre multele întrebări "
          "despre lume care s-ar putea pune aici.",
    "xx": "мама мыла раму и читала книгу о том как жили люди в старом городе у моря 我们小时候在街上玩 父亲在看报纸喝咖啡 これは最初の質問です 私たちはここに住んでいます "
          "το παλιό σπίτι βρίσκεται στο τέλος του δρόμου البيت القديم يقع في نهاية الشارع הבית הישן עומד בסוף הרחוב पुराना घर सड़क के अंत में है 오래된 집은 길 끝에 있다",
}
