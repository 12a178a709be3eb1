"""Ordinary paragraphs that no table of the test data holds, eight in each of thirteen languages."""

PARAGRAPHS = {
    "en": """The city council decided yesterday that the new bridge will be built next year. Several members said that the old one could no longer carry the traffic of a growing town.
My grandmother kept her letters in a tin box under the bed, and nobody was allowed to open it. After she died we found that most of them had been written by a man none of us had ever met.
Water boils at a lower temperature in the mountains because the air pressure is lower there. That is why pasta takes longer to cook in a hut than it does at home by the sea.
Permission is hereby granted to any person who obtains a copy of this work to use it without charge, provided that the notice above is kept in every copy that is passed on to others.
The function returns the first element for which the test succeeds, or the default value if there is none. It does not change the list, so it can be called again with another test.
She had never been good at goodbyes, so she left before the others were awake. On the kitchen table there was a short note, a little money for the rent, and the key of the garden gate.
Scientists have long wondered how birds find their way across the ocean at night. Recent experiments suggest that they can sense the magnetic field of the earth with their eyes.
The match was stopped after twenty minutes when heavy rain flooded the pitch. Both teams agreed to play again on Sunday, although many of the visitors had already gone home.""",
    "de": """Der Stadtrat hat gestern beschlossen, dass die neue Brücke im nächsten Jahr gebaut wird. Mehrere Mitglieder sagten, die alte könne den Verkehr einer wachsenden Stadt nicht mehr tragen.
Meine Großmutter bewahrte ihre Briefe in einer Blechdose unter dem Bett auf, und niemand durfte sie öffnen. Erst nach ihrem Tod erfuhren wir, von wem sie waren.
Im Gebirge kocht Wasser schon bei niedrigerer Temperatur, weil dort der Luftdruck geringer ist. Deshalb brauchen Nudeln in einer Hütte länger als zu Hause am Meer.
Die Funktion gibt das erste Element zurück, für das die Prüfung gelingt, oder den Vorgabewert, wenn es keines gibt. Die Liste selbst wird dabei nicht verändert.
Sie konnte sich noch nie gut verabschieden, deshalb ging sie, bevor die anderen wach waren. Auf dem Küchentisch lagen ein kurzer Zettel und der Schlüssel zum Gartentor.
Forscher fragen sich seit langem, wie Vögel nachts ihren Weg über das Meer finden. Neue Versuche deuten darauf hin, dass sie das Magnetfeld der Erde mit den Augen wahrnehmen.
Das Spiel wurde nach zwanzig Minuten abgebrochen, weil starker Regen den Platz überflutet hatte. Beide Mannschaften einigten sich darauf, am Sonntag noch einmal anzutreten.
Wer im Herbst durch den Wald geht, riecht das nasse Laub und die Pilze schon von weitem. An manchen Tagen hört man nur den eigenen Atem und ab und zu einen Specht.""",
    "fr": """Le conseil municipal a décidé hier que le nouveau pont serait construit l'année prochaine. Plusieurs élus ont dit que l'ancien ne pouvait plus supporter la circulation d'une ville qui grandit.
Ma grand-mère gardait ses lettres dans une boîte en fer sous son lit, et personne n'avait le droit de l'ouvrir. Nous avons appris bien plus tard de qui elles venaient.
En montagne, l'eau bout à une température plus basse parce que la pression de l'air y est plus faible. C'est pourquoi les pâtes mettent plus longtemps à cuire dans un refuge.
La fonction renvoie le premier élément pour lequel le test réussit, ou la valeur par défaut s'il n'y en a pas. Elle ne modifie pas la liste qu'on lui donne.
Elle n'avait jamais su dire au revoir, alors elle est partie avant que les autres ne se réveillent. Sur la table de la cuisine, il y avait un mot et la clé du jardin.
Les savants se demandent depuis longtemps comment les oiseaux trouvent leur chemin la nuit au-dessus de la mer. Des essais récents montrent qu'ils perçoivent le champ magnétique.
Le match a été arrêté au bout de vingt minutes, car une forte pluie avait inondé le terrain. Les deux équipes se sont mises d'accord pour rejouer dimanche.
Quand on marche dans la forêt en automne, on sent de loin les feuilles mouillées et les champignons. Certains jours, on n'entend que son propre souffle.""",
    "es": """El ayuntamiento decidió ayer que el nuevo puente se construirá el año que viene. Varios concejales dijeron que el antiguo ya no podía soportar el tráfico de una ciudad que crece.
Mi abuela guardaba sus cartas en una caja de lata debajo de la cama, y nadie podía abrirla. Mucho después supimos que las había escrito un hombre al que ninguno conocía.
En la montaña el agua hierve a una temperatura más baja porque la presión del aire es menor. Por eso la pasta tarda más en cocerse en un refugio que en casa.
La función devuelve el primer elemento para el que la prueba tiene éxito, o el valor por defecto si no hay ninguno. No cambia la lista que se le da.
Nunca se le habían dado bien las despedidas, así que se marchó antes de que los demás despertaran. En la mesa de la cocina dejó una nota y la llave del jardín.
Los científicos se preguntan desde hace tiempo cómo encuentran las aves su camino de noche sobre el mar. Ensayos recientes indican que perciben el campo magnético.
El partido se suspendió a los veinte minutos porque la lluvia había inundado el campo. Los dos equipos acordaron volver a jugar el domingo por la tarde.
Quien camina por el bosque en otoño huele desde lejos las hojas mojadas y las setas. Hay días en que solo se oye la propia respiración.""",
    "it": """Il consiglio comunale ha deciso ieri che il nuovo ponte sarà costruito l'anno prossimo. Alcuni consiglieri hanno detto che quello vecchio non regge più il traffico di una città che cresce.
Mia nonna teneva le sue lettere in una scatola di latta sotto il letto, e nessuno poteva aprirla. Solo dopo la sua morte abbiamo saputo chi le aveva scritte.
In montagna l'acqua bolle a una temperatura più bassa perché la pressione dell'aria è minore. Per questo la pasta ci mette di più a cuocere in un rifugio che a casa.
La funzione restituisce il primo elemento per cui la prova riesce, oppure il valore predefinito se non ce n'è nessuno. La lista che le viene data non cambia.
Non era mai stata brava con gli addii, così se ne andò prima che gli altri si svegliassero. Sul tavolo della cucina lasciò un biglietto e la chiave del giardino.
Gli scienziati si chiedono da tempo come facciano gli uccelli a trovare la strada di notte sopra il mare. Prove recenti fanno pensare che sentano il campo magnetico.
La partita è stata sospesa dopo venti minuti perché la pioggia aveva allagato il campo. Le due squadre si sono accordate per rigiocare domenica.
Chi cammina nel bosco in autunno sente da lontano l'odore delle foglie bagnate e dei funghi. Certi giorni si sente solo il proprio respiro.""",
    "pt": """A câmara municipal decidiu ontem que a nova ponte será construída no próximo ano. Vários vereadores disseram que a antiga já não aguenta o trânsito de uma cidade que cresce.
A minha avó guardava as cartas numa caixa de lata debaixo da cama, e ninguém a podia abrir. Só depois de ela morrer soubemos quem as tinha escrito.
Na montanha a água ferve a uma temperatura mais baixa porque a pressão do ar é menor. Por isso a massa demora mais a cozer num abrigo do que em casa.
A função devolve o primeiro elemento para o qual o teste tem sucesso, ou o valor predefinido se não houver nenhum. A lista que lhe é dada não muda.
Ela nunca tinha sido boa em despedidas, por isso saiu antes de os outros acordarem. Na mesa da cozinha ficaram um bilhete e a chave do portão.
Os cientistas perguntam há muito tempo como as aves encontram o caminho de noite sobre o mar. Ensaios recentes indicam que elas sentem o campo magnético da terra.
O jogo foi interrompido ao fim de vinte minutos porque a chuva tinha inundado o campo. As duas equipas combinaram voltar a jogar no domingo.
Quem anda pela floresta no outono sente de longe o cheiro das folhas molhadas e dos cogumelos. Há dias em que só se ouve a própria respiração.""",
    "nl": """De gemeenteraad heeft gisteren besloten dat de nieuwe brug volgend jaar wordt gebouwd. Verschillende leden zeiden dat de oude het verkeer van een groeiende stad niet meer aankan.
Mijn grootmoeder bewaarde haar brieven in een blikken doos onder het bed, en niemand mocht hem openen. Pas na haar dood hoorden we van wie ze waren.
In de bergen kookt water bij een lagere temperatuur omdat de luchtdruk daar lager is. Daarom heeft pasta in een hut meer tijd nodig dan thuis aan zee.
De functie geeft het eerste element terug waarvoor de toets slaagt, of de standaardwaarde als er geen is. De lijst zelf wordt daarbij niet veranderd.
Ze was nooit goed geweest in afscheid nemen, dus ging ze weg voordat de anderen wakker waren. Op de keukentafel lagen een briefje en de sleutel van het tuinhek.
Onderzoekers vragen zich al lang af hoe vogels 's nachts hun weg over zee vinden. Nieuwe proeven wijzen erop dat ze het magnetisch veld van de aarde kunnen zien.
De wedstrijd werd na twintig minuten gestaakt omdat hevige regen het veld had overstroomd. Beide ploegen spraken af om op zondag opnieuw te spelen.
Wie in de herfst door het bos loopt, ruikt van ver de natte bladeren en de paddenstoelen. Op sommige dagen hoor je alleen je eigen adem.""",
    "pl": """Rada miasta zdecydowała wczoraj, że nowy most zostanie zbudowany w przyszłym roku. Kilku radnych mówiło, że stary nie wytrzymuje już ruchu w mieście, które wciąż rośnie.
Moja babcia trzymała listy w blaszanym pudełku pod łóżkiem i nikt nie mógł go otworzyć. Dopiero po jej śmierci dowiedzieliśmy się, kto je napisał.
W górach woda wrze w niższej temperaturze, bo ciśnienie powietrza jest tam mniejsze. Dlatego makaron gotuje się w schronisku dłużej niż w domu nad morzem.
Funkcja zwraca pierwszy element, dla którego test się powiedzie, albo wartość domyślną, jeśli go nie ma. Sama lista nie jest przy tym zmieniana.
Nigdy nie umiała się żegnać, więc wyszła, zanim inni się obudzili. Na stole w kuchni zostawiła krótką kartkę i klucz do furtki.
Naukowcy od dawna pytają, jak ptaki znajdują nocą drogę nad morzem. Nowe badania wskazują, że potrafią one widzieć pole magnetyczne ziemi.
Mecz przerwano po dwudziestu minutach, bo ulewny deszcz zalał boisko. Obie drużyny umówiły się, że zagrają jeszcze raz w niedzielę.
Kto jesienią idzie przez las, z daleka czuje mokre liście i grzyby. Bywają dni, kiedy słychać tam tylko własny oddech.""",
    "ru": """Городской совет вчера решил, что новый мост будет построен в следующем году. Несколько депутатов сказали, что старый уже не выдерживает движения в городе, который всё растёт.
Моя бабушка хранила письма в жестяной коробке под кроватью, и никому не разрешалось её открывать. Только после её смерти мы узнали, кто их написал.
В горах вода кипит при более низкой температуре, потому что давление воздуха там меньше. Поэтому макароны в хижине варятся дольше, чем дома у моря.
Функция возвращает первый элемент, для которого проверка прошла успешно, или значение по умолчанию, если такого нет. Сам список при этом не меняется.
Она никогда не умела прощаться и поэтому ушла, пока все ещё спали. На кухонном столе лежали короткая записка и ключ от садовой калитки.
Учёные давно спрашивают себя, как птицы ночью находят дорогу над морем. Новые опыты показывают, что они видят магнитное поле земли.
Игру остановили через двадцать минут, потому что сильный дождь залил поле. Обе команды договорились сыграть ещё раз в воскресенье.
Кто осенью идёт по лесу, тот издалека чувствует запах мокрых листьев и грибов. Бывают дни, когда слышно только собственное дыхание.""",
    "sv": """Kommunfullmäktige beslutade i går att den nya bron ska byggas nästa år. Flera ledamöter sade att den gamla inte längre klarar trafiken i en stad som växer.
Min mormor förvarade sina brev i en plåtask under sängen, och ingen fick öppna den. Först efter hennes död fick vi veta vem som hade skrivit dem.
I bergen kokar vatten vid en lägre temperatur eftersom lufttrycket är lägre där. Därför tar det längre tid att koka pasta i en stuga än hemma vid havet.
Funktionen ger tillbaka det första element som klarar provet, eller standardvärdet om det inte finns något. Själva listan ändras inte.
Hon hade aldrig varit bra på avsked, så hon gick innan de andra hade vaknat. På köksbordet låg en kort lapp och nyckeln till grinden.
Forskare har länge undrat hur fåglar hittar vägen över havet om natten. Nya försök tyder på att de kan se jordens magnetfält.
Matchen avbröts efter tjugo minuter eftersom kraftigt regn hade dränkt planen. Båda lagen kom överens om att spela igen på söndag.
Den som går genom skogen på hösten känner på långt håll lukten av våta löv och svamp. Vissa dagar hör man bara sin egen andning.""",
    "tr": """Belediye meclisi dün yeni köprünün gelecek yıl yapılmasına karar verdi. Bazı üyeler eski köprünün büyüyen bir kentin trafiğini artık taşıyamadığını söyledi.
Büyükannem mektuplarını yatağın altında bir teneke kutuda saklardı ve onu açmak kimseye serbest değildi. Kimin yazdığını ancak o öldükten sonra öğrendik.
Dağlarda su daha düşük bir sıcaklıkta kaynar, çünkü orada hava basıncı daha azdır. Bu yüzden makarna bir kulübede evdekinden daha geç pişer.
Bu işlev, sınamanın başarılı olduğu ilk öğeyi verir, öyle bir öğe yoksa ön tanımlı değeri döndürür. Listenin kendisi bu sırada değişmez.
Vedalaşmayı hiç beceremezdi, o yüzden ötekiler uyanmadan önce evden çıktı. Mutfak masasında kısa bir not ile bahçe kapısının anahtarı duruyordu.
Bilim insanları kuşların gece denizin üstünde yolu nasıl bulduğunu uzun süredir merak ediyor. Yeni deneyler onların dünyanın manyetik alanını gördüğünü gösteriyor.
Maç yirmi dakika sonra durduruldu, çünkü şiddetli yağmur sahayı su altında bırakmıştı. İki takım pazar günü bir daha oynamak için anlaştı.
Sonbaharda ormanda yürüyen biri ıslak yaprakların ve mantarların kokusunu uzaktan alır. Bazı günler insan yalnız kendi soluğunu duyar.""",
    "ko": """시의회는 어제 새로운 다리를 내년에 짓기로 결정했다. 여러 의원은 오래된 다리가 커지는 도시의 교통을 더는 견디지 못한다고 말했다.
우리 할머니는 편지를 침대 밑의 양철 상자에 보관했고 아무도 그것을 열 수 없었다. 우리는 할머니가 돌아가신 뒤에야 누가 그 편지를 썼는지 알게 되었다.
산에서는 공기의 압력이 낮기 때문에 물이 더 낮은 온도에서 끓는다. 그래서 국수는 바닷가의 집에서보다 산장에서 더 오래 삶아야 한다.
이 함수는 검사를 통과한 첫 번째 원소를 돌려주고 그런 원소가 없으면 기본값을 돌려준다. 목록 자체는 바뀌지 않는다.
그녀는 작별 인사를 잘하지 못해서 다른 사람들이 깨기 전에 집을 나섰다. 부엌 식탁에는 짧은 쪽지와 정원 문의 열쇠가 놓여 있었다.
과학자들은 새들이 밤에 어떻게 바다를 건너는 길을 찾는지 오랫동안 궁금해했다. 최근의 실험은 새들이 지구의 자기장을 눈으로 느낀다는 것을 보여 준다.
경기는 많은 비가 운동장에 넘쳐서 이십 분 만에 중단되었다. 두 팀은 일요일에 다시 경기를 하기로 합의했다.
가을에 숲을 걷는 사람은 젖은 잎과 버섯의 냄새를 멀리서도 맡는다. 어떤 날에는 자신의 숨소리만 들린다.""",
    "zh": """市议会昨天决定，新的大桥将在明年动工。几位议员说，旧桥已经不能承受这个不断长大的城市的交通。
我的外婆把她的信放在床下的铁盒里，谁也不可以打开。她去世以后，我们才知道那些信是一个我们都不认识的人写的。
在山上，因为气压比较低，水在更低的温度就会沸腾。所以在山上的小屋里煮面，要比在海边的家里花更多的时间。
这个函数返回第一个通过测试的元素，如果没有这样的元素，就返回默认的值。列表本身在这个过程中是不会改变的。
她从来不会和人告别，所以在别人醒来之前就离开了家。厨房的桌子上有一张纸条和花园大门的钥匙。
科学家很久以来都想知道，鸟是怎么在夜里飞过大海而不迷路的。最近的实验说明，它们可以用眼睛看到地球的磁场。
比赛在二十分钟以后被中断了，因为大雨把球场淹没了。两个队同意在星期天的下午再比一次。
秋天走在树林里的人，从很远的地方就能闻到湿树叶和蘑菇的气味。有的日子里，人们只能听到自己的呼吸。""",
}
