"""The same few sentences in many languages and scripts."""

PROSE = {
 "ru": "Пациент должен подтвердить личность до выдачи лекарства. Медсестра записывает время и дозу в журнал, а затем передаёт сведения врачу. Если врач не отвечает в течение часа, система сообщает об этом заведующему отделением. После проверки рецепт возвращается в аптеку, где его хранят вместе с другими документами.",
 "it": "Il paziente deve confermare la propria identità prima della consegna del farmaco. L'infermiera annota l'ora e la dose nel registro, poi informa il medico di turno. Se il medico non risponde entro un'ora, il sistema avvisa il responsabile del reparto. Dopo la verifica la ricetta torna in farmacia, dove viene conservata con gli altri documenti.",
 "pt": "O paciente deve confirmar a identidade antes da entrega do medicamento. A enfermeira anota a hora e a dose no registro e depois avisa o médico. Se o médico não responder em uma hora, o sistema avisa o responsável pelo setor. Depois da verificação a receita volta para a farmácia, onde fica guardada com os outros documentos.",
 "pl": "Pacjent musi potwierdzić tożsamość przed wydaniem leku. Pielęgniarka zapisuje godzinę oraz dawkę w rejestrze, a potem powiadamia lekarza dyżurnego. Jeśli lekarz nie odpowie w ciągu godziny, system zawiadamia kierownika oddziału. Po sprawdzeniu recepta wraca do apteki, gdzie przechowuje się ją razem z innymi dokumentami.",
 "fi": "Potilaan on vahvistettava henkilöllisyytensä ennen lääkkeen luovutusta. Sairaanhoitaja kirjaa ajan ja annoksen rekisteriin ja ilmoittaa sitten lääkärille. Jos lääkäri ei vastaa tunnin kuluessa, järjestelmä ilmoittaa asiasta osaston esimiehelle. Tarkistuksen jälkeen resepti palautetaan apteekkiin, jossa sitä säilytetään muiden asiakirjojen kanssa.",
 "tr": "Hasta, ilaç verilmeden önce kimliğini doğrulamalıdır. Hemşire saati ve dozu kayıt defterine yazar, ardından nöbetçi hekime bilgi verir. Hekim bir saat içinde yanıt vermezse sistem durumu servis sorumlusuna bildirir. Kontrolden sonra reçete eczaneye geri gönderilir ve diğer belgelerle birlikte saklanır.",
 "el": "Ο ασθενής πρέπει να επιβεβαιώσει την ταυτότητά του πριν από την παράδοση του φαρμάκου. Η νοσοκόμα σημειώνει την ώρα και τη δόση στο μητρώο και ενημερώνει τον γιατρό. Αν ο γιατρός δεν απαντήσει μέσα σε μία ώρα, το σύστημα ειδοποιεί τον υπεύθυνο του τμήματος.",
 "ar": "يجب على المريض أن يؤكد هويته قبل تسليم الدواء. تسجل الممرضة الوقت والجرعة في السجل ثم تخبر الطبيب المناوب. إذا لم يرد الطبيب في غضون ساعة فإن النظام يبلغ رئيس القسم. بعد المراجعة تعاد الوصفة إلى الصيدلية حيث تحفظ مع باقي الوثائق.",
 "he": "המטופל חייב לאמת את זהותו לפני מסירת התרופה. האחות רושמת את השעה ואת המינון ביומן ואז מודיעה לרופא התורן. אם הרופא אינו משיב בתוך שעה המערכת מודיעה למנהל המחלקה. לאחר הבדיקה המרשם חוזר לבית המרקחת ונשמר שם עם שאר המסמכים.",
 "hi": "दवा देने से पहले रोगी को अपनी पहचान की पुष्टि करनी होगी। नर्स समय और खुराक को रजिस्टर में लिखती है और फिर डॉक्टर को सूचना देती है। यदि डॉक्टर एक घंटे में उत्तर नहीं देता तो प्रणाली विभाग के प्रमुख को सूचित करती है।",
 "ta": "மருந்து வழங்குவதற்கு முன் நோயாளி தனது அடையாளத்தை உறுதிப்படுத்த வேண்டும். செவிலியர் நேரத்தையும் மருந்தின் அளவையும் பதிவேட்டில் எழுதி மருத்துவருக்குத் தெரிவிக்கிறார். மருத்துவர் ஒரு மணி நேரத்திற்குள் பதிலளிக்காவிட்டால் அமைப்பு துறைத் தலைவருக்கு அறிவிக்கும்.",
 "zh": "患者在领取药品之前必须确认身份。护士把时间和剂量记入登记簿，然后通知值班医生。如果医生在一小时内没有答复，系统会通知科室负责人。检查之后，处方退回药房，与其他文件一起保存。",
 "ja": "患者は薬を受け取る前に本人確認をしなければならない。看護師は時刻と用量を記録簿に書き、その後当直の医師に知らせる。医師が一時間以内に返答しない場合、システムは病棟の責任者に通知する。確認の後、処方箋は薬局に戻され、他の書類とともに保管される。",
 "ko": "환자는 약을 받기 전에 신원을 확인해야 한다. 간호사는 시간과 용량을 기록부에 적고 당직 의사에게 알린다. 의사가 한 시간 안에 답하지 않으면 시스템이 병동 책임자에게 통보한다. 확인이 끝나면 처방전은 약국으로 돌아가 다른 서류와 함께 보관된다.",
 "th": "ผู้ป่วยต้องยืนยันตัวตนก่อนรับยา พยาบาลบันทึกเวลาและขนาดยาลงในทะเบียนแล้วแจ้งแพทย์เวร หากแพทย์ไม่ตอบภายในหนึ่งชั่วโมงระบบจะแจ้งหัวหน้าหอผู้ป่วย หลังจากตรวจสอบแล้วใบสั่งยาจะถูกส่งกลับไปยังห้องยา",
 "sw": "Mgonjwa lazima athibitishe utambulisho wake kabla ya kupewa dawa. Muuguzi huandika saa na kipimo kwenye daftari kisha humjulisha daktari wa zamu. Ikiwa daktari hajibu ndani ya saa moja, mfumo humjulisha mkuu wa idara. Baada ya ukaguzi cheti hurudishwa kwenye duka la dawa.",
 "hu": "A betegnek igazolnia kell magát a gyógyszer átadása előtt. A nővér feljegyzi az időt és az adagot a nyilvántartásba, majd értesíti az ügyeletes orvost. Ha az orvos egy órán belül nem válaszol, a rendszer értesíti az osztály vezetőjét. Az ellenőrzés után a vény visszakerül a gyógyszertárba.",
 "vi": "Bệnh nhân phải xác nhận danh tính trước khi nhận thuốc. Y tá ghi thời gian và liều lượng vào sổ rồi báo cho bác sĩ trực. Nếu bác sĩ không trả lời trong vòng một giờ, hệ thống sẽ báo cho trưởng khoa.",
 "de": "Der Patient muss vor der Ausgabe des Arzneimittels seine Identität bestätigen. Die Pflegekraft trägt Uhrzeit und Dosis in das Register ein und benachrichtigt danach den diensthabenden Arzt.",
 "en": "The patient must confirm their identity before the drug is handed over. The nurse writes the time and the dose into the register and then tells the physician on duty.",
}
