"""Sentences for what the generated documents never hold, and what their detectors are to make of them: see tests/test_spans.py."""

SENTENCES = (
    "Journal 640823-3234 låg i pärmen.", "196408233234", "640823-3231 stämde inte.", "(nr 050614-2345),", "faktura 881345-1200 betald", "kod640823-3234b",
    "Nås på 073-555 01 23 efter lunch", "040-555123 4567890", "0712012345", "Utredning F84.1 och G40 är klara", "hylla QX12 och QXA12 står tomma", "Lindgatan 7 lgh 1203",
    "Flyttade till Ekvägen 14C i maj.", "Kontoret ligger på Södra Hamngatan 22.", "Hela vägen var snöig.", "Barnet börjar på Ängsskolan nu.", "Bergagymnasiets kurator svarade.", "De möttes utanför skolan.",
    "Läs https://vattenbruk.se/nytt, eller www.hamn.example!", "dator 10.20.30.40 är avstängd", "utgåva 2.4.6.8.1 kom",
    "Chen Lund bor på Lundgatan 3 i Lund, chen.lund@lund.se, tel 070-555 12 34.", "Anna och Anna Berg mötte Björn Berg på Bergaskolan i Berg.", "Sten läste om ADHD, adhd och Autism; CP och cp.",
    "Ann-Brittas vän Ann-Britt gav Ann alvedon i Upplands Väsby.", "Maria  Berg\nvar hemma. maria  berg kom\ttill Malmö, Malmöbo och Erik-Sten.", "Leon, Stein och Chen fick Concerta på Södra vägen 9 i Göteborg.",
)
